"""Window and sequence queries on trajectories, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.operators import align, sequence, windows

from .bindings import TRAJ, read, rounded, trajectory

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def texts(v, sep=","):
    return F.array_join(F.transform(v, lambda x: x.cast("string")), sep)


def _seconds(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.withColumn("t", align.seconds(F.col("ts")))


@query("""with s as (select l_orderkey as episode, 0::bigint as seg_start, (l_linenumber + cast(l_quantity as bigint))::bigint as seg_end, l_linenumber, l_partkey from lineitem),
    r as (select * from (values (1::bigint, 33::bigint), (2, 65), (4, 129)) r(ratio, span))
    select episode, l_linenumber, l_partkey, ratio, span, unnest(range(seg_start, seg_end - span + 1)) as clip_start from s join r on seg_end - seg_start >= span""")
def clip_plan(spark, sf_dir):
    """Every clip start of segments at three frequency ratios."""
    li = read(spark, sf_dir, "lineitem")
    seg = li.select(F.col("l_orderkey").alias("episode"), "l_linenumber", "l_partkey", F.lit(0).cast("long").alias("seg_start"), (F.col("l_linenumber") + F.floor("l_quantity")).alias("seg_end"))
    return windows.clip_plan(seg, "seg_start", "seg_end", [1, 2, 4]).drop("seg_start", "seg_end")


@query(f"""with {TRAJ}, n as (select episode, count(*) as n from traj group by 1), c as (select episode, unnest(range(0, n - 33 + 1)) as clip_start from n where n >= 33)
    select episode, clip_start, array_to_string([clip_start + i * 4 for i in range(0, 9)], ',') as images, clip_start + 31 as last_action from c""")
def clip_frames(spark, sf_dir):
    """Image and action places of every clip of each episode at ratio 1."""
    seg = trajectory(spark, sf_dir).groupBy("episode").agg(F.count(F.lit(1)).alias("n")).select("episode", F.lit(0).cast("long").alias("s"), F.col("n").alias("e"))
    c = windows.clip_frames(windows.clip_plan(seg, "s", "e", [1]))
    return c.select("episode", "clip_start", texts(F.col("image_frames")).alias("images"), F.element_at("action_frames", -1).alias("last_action"))


@query(f"with {TRAJ}, n as (select episode, count(*) as n from traj group by 1) select episode, n, ('0x' || substr(md5('42:' || episode::varchar), 1, 8))::bigint % (n - 33 + 1) as clip_start from n where n >= 33")
def random_start(spark, sf_dir):
    """One clip start of each episode by hash."""
    seg = trajectory(spark, sf_dir).groupBy("episode").agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(0).cast("long"))
    return windows.random_start(seg, "s", "n", 33, ["episode"], 42).select("episode", "n", "clip_start")


@query(f"""with {TRAJ}, h as (select t.vec_id, t.frame_index, (select list(p.vec_id order by p.frame_index) from traj p where p.episode = t.episode and p.frame_index < t.frame_index
      and p.frame_index >= t.frame_index - 12 and (t.frame_index - p.frame_index) % 3 = 0) as h from traj t)
    select vec_id, array_to_string([-1 for i in range(0, 4 - coalesce(len(h), 0))] || coalesce(h, []), ',') as history, coalesce(len(h), 0)::int as valid from h""")
def strided_history(spark, sf_dir):
    """Up to 4 earlier rows, 3 apart, padded in front."""
    h = windows.strided_history(trajectory(spark, sf_dir), "vec_id", "frame_index", 3, 4, ["episode"], F.lit(-1).cast("long"))
    valid = F.size(F.filter("history_mask", lambda m: m))
    return h.select("vec_id", texts(F.col("history")).alias("history"), valid.alias("valid"))


@query(f"""with {TRAJ}, n as (select *, max(frame_index) over (partition by episode) as last from traj)
    select a.vec_id, array_to_string((select list(b.vec_id order by i) from range(0, 8) r(i) join traj b on b.episode = a.episode and b.frame_index = least(a.frame_index + i, a.last)), ',') as chunk from n a""")
def lookahead_pad(spark, sf_dir):
    """The next 8 rows of each row; the last one repeats."""
    c = windows.lookahead(trajectory(spark, sf_dir), "vec_id", 8, ["episode"], ["frame_index"])
    return c.select("vec_id", texts(F.col("chunk")).alias("chunk"))


@query(f"with {TRAJ}, n as (select *, count(*) over (partition by episode) as n from traj) select vec_id from n where frame_index <= n - 16")
def complete_chunks(spark, sf_dir):
    """Rows with 16 rows from themselves on."""
    return windows.complete_chunks(trajectory(spark, sf_dir), 16, ["episode"], ["frame_index"]).select("vec_id")


INTERVALS = "iv as (select episode, s, least(s + 5, 10000) as e from (select distinct episode from traj) cross join (values (7::bigint), (20::bigint), (33::bigint)) v(s))"
KEYFRAMES = f"""{INTERVALS}, b as (select t.episode, t.frame_index, t.vec_id, max(i.e) as till, min(t.frame_index) over (partition by t.episode) as f, max(t.frame_index) over (partition by t.episode) as l
      from traj t left join iv i on i.episode = t.episode and i.s <= t.frame_index group by 1, 2, 3),
    kept as (select episode, frame_index, coalesce(frame_index <= till, false) as in_interval from b
      where coalesce(frame_index <= till, false) or (frame_index - coalesce(till + 1, f)) % 4 = 0 or frame_index in (f, l))"""


def _kept(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    starts = F.array(*[F.lit(x).cast("long") for x in (7, 20, 33)])
    intervals = t.select("episode").distinct().withColumn("start", F.explode(starts)).withColumn("end", F.col("start") + 5)
    return windows.keyframes(t, intervals, 4, ["episode"], "frame_index")


@query(f"with {TRAJ}, {KEYFRAMES} select episode, frame_index, in_interval from kept")
def keyframe_select(spark, sf_dir):
    """Frames inside key intervals, every fourth between them, first and last."""
    return _kept(spark, sf_dir)


@query(f"""with {TRAJ}, {KEYFRAMES}, w as (select episode, frame_index, list(frame_index) over (partition by episode order by frame_index rows between current row and 16 following) as w from kept),
    d as (select *, [w[i + 1] - w[i] for i in range(1, 17)] as d from w where len(w) = 17)
    select episode, frame_index, array_to_string([w[i] for i in range(1, 18, 4)], ',') as images, (w[17] - w[1] + 1) as span, case when list_min(d) = list_max(d) and list_min(d) > 0 then list_min(d) end as step from d""")
def keyframe_window(spark, sf_dir):
    """Every run of 16 + 1 kept frames."""
    w = windows.keyframe_windows(_kept(spark, sf_dir), ["episode"], "frame_index", actions=16)
    return w.select("episode", "frame_index", texts(F.col("image_frames")).alias("images"), "span", "step")


@query("""select user_id, event_id, coalesce(value >= 10 and lag(value) over w < 10, false) as edge from events window w as (partition by user_id order by ts, event_id)""")
def rising_edge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return sequence.rising_edges(e, "value", 10.0, ["user_id"], ["ts", "event_id"], "edge").select("user_id", "event_id", "edge")


@query("""select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r, count(*) over (partition by user_id) as n from events) where r <= 64 and n >= 64""")
def fixed_last_n(spark, sf_dir):
    """The last 64 events of users that have as many; nothing of the others."""
    return sequence.last_rows(read(spark, sf_dir, "events"), 64, ["user_id"], ["ts", "event_id"], exact=True).select("user_id", "event_id")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 72")
def last_n(spark, sf_dir):
    """A ring buffer's content: the last 72 events of each user, or all."""
    return sequence.last_rows(read(spark, sf_dir, "events"), 72, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""with f as (select user_id, min(ts) as failed_at from events where event_type = 'error' group by 1)
    select e.user_id, e.event_id, case when e.ts <= f.failed_at then 'loser' else 'after' end as side from events e join f using (user_id)""")
def failure_split(spark, sf_dir):
    """Events up to the first error of their user, that one included, and later ones."""
    e = read(spark, sf_dir, "events")
    failed = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("failed_at"))
    return windows.split_by_time(e.join(failed, "user_id"), "ts", "failed_at").select("user_id", "event_id", "side")


@query(f"""with {TRAJ}, i as (select *, max(frame_index // 8) over (partition by episode) as m from traj)
    select vec_id, frame_index // 8 as batch_id, frame_index % 8 as batch_pos, frame_index < 8 as first_batch, (frame_index // 8) = m as last_batch from i""")
def batch_split(spark, sf_dir):
    """Batches of 8 with flags."""
    return sequence.batches(trajectory(spark, sf_dir), 8, ["episode"], ["frame_index"]).select("vec_id", "batch_id", "batch_pos", "first_batch", "last_batch")


@query(f"""with {TRAJ}, d as (select *, case when frame_index % 8 = 0 then 0.6 else 0.1 end::double as d from traj)
    select vec_id, round(sum(d) over w - d, 6) + 0.0 as starts_at, round(sum(d) over w, 6) + 0.0 as arrives_at from d window w as (partition by episode order by frame_index rows unbounded preceding)""")
def schedule_cumsum(spark, sf_dir):
    """When each waypoint starts and arrives."""
    t = trajectory(spark, sf_dir).withColumn("d", F.when(F.col("frame_index") % 8 == 0, 0.6).otherwise(0.1))
    s = sequence.schedule(t, "d", ["episode"], ["frame_index"])
    return s.select("vec_id", rounded(F.col("starts_at")).alias("starts_at"), rounded(F.col("arrives_at")).alias("arrives_at"))


@query(f"with {TRAJ}, n as (select *, count(*) over (partition by episode) as n from traj) select vec_id from n where frame_index < ((n - 1) // 4) * 4 + 1")
def vae_trim(spark, sf_dir):
    """The 1 + 4k first frames that an encoder takes."""
    n = F.count(F.lit(1)).over(Window.partitionBy("episode"))
    return trajectory(spark, sf_dir).withColumn("n", n).where(F.col("frame_index") < windows.trim_count(F.col("n"), 4)).select("vec_id")


@query(f"""with {TRAJ}, l as (select episode, list(vec_id order by frame_index) as v from traj group by 1)
    select episode, array_to_string([v[least(i, len(v))] for i in range(1, 53)], ',') as v52, len(v)::int as n from l""")
def fit_length(spark, sf_dir):
    """52 values of each episode: cut, or the last one repeated."""
    g = trajectory(spark, sf_dir).groupBy("episode").agg(F.array_sort(F.collect_list("vec_id")).alias("v"))
    return g.select("episode", texts(windows.fit_length(F.col("v"), 52)).alias("v52"), F.size("v").alias("n"))


@query(f"""with {TRAJ} select vec_id, round(coalesce(lead(action[1]) over w, action[1]), 6) + 0.0 as nxt, round(coalesce(lag(action[1]) over w, action[1]), 6) + 0.0 as prv,
    round(max(action[1]) over (partition by episode order by frame_index rows unbounded preceding), 6) + 0.0 as top from traj window w as (partition by episode order by frame_index)""")
def next_previous(spark, sf_dir):
    """Next and previous value (edges have their own) and the running maximum."""
    t = trajectory(spark, sf_dir).withColumn("x", F.get("action", F.lit(0)))
    by, order = ["episode"], ["frame_index"]
    t = sequence.running_max(sequence.with_previous(sequence.with_next(t, "x", by, order, "nxt"), "x", by, order, "prv"), "x", by, order, "top")
    return t.select("vec_id", *[rounded(F.col(c)).alias(c) for c in ("nxt", "prv", "top")])


@query("""with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6::double as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
    g as (select user_id, event_id, t, k, t as last, true as passed from e where k = 1
      union all select e.user_id, e.event_id, e.t, e.k, case when e.t - g.last >= 43200 then e.t else g.last end, e.t - g.last >= 43200 from g join e on e.user_id = g.user_id and e.k = g.k + 1)
    select user_id, event_id from g where passed""")
def rate_gate(spark, sf_dir):
    """Events at least twelve hours after the last one that passed."""
    return sequence.rate_gate(_seconds(spark, sf_dir), "t", 43200.0, ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("""with f as (select *, value > 8 as failed, sum((not value > 8)::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events)
    select user_id, event_id, (sum(failed::int) over (partition by user_id, island order by ts, event_id rows unbounded preceding))::bigint as streak,
    (sum(failed::int) over (partition by user_id, island order by ts, event_id rows unbounded preceding)) >= 5 as tripped from f""")
def error_trip(spark, sf_dir):
    """Five failures in a row trip; a success resets."""
    e = read(spark, sf_dir, "events").withColumn("failed", F.col("value") > 8)
    return sequence.error_trips(e, "failed", 5, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "streak", "tripped")


@query("""select user_id, event_id, value, case when (epoch_us(ts) - epoch_us(coalesce(lag(ts) over w, ts))) / 1e6::double > 21600 then 0.0 else value end as held from events window w as (partition by user_id order by ts, event_id)""")
def dead_man(spark, sf_dir):
    """A command counts as zero after six hours of silence."""
    e = sequence.with_previous(_seconds(spark, sf_dir), "t", ["user_id"], ["ts", "event_id"], "before")
    return e.select("user_id", "event_id", "value", F.when(F.col("t") - F.col("before") > 21600, 0.0).otherwise(F.col("value")).alias("held"))


@query("""with g as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as generation from events),
    m as (select *, max(generation) over (partition by user_id) as newest from g) select user_id, event_id, generation::bigint as generation from m where generation = newest""")
def generation_fence(spark, sf_dir):
    """Results of a user's newest generation; a signup starts one."""
    run = sequence.ordered(["user_id"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    g = read(spark, sf_dir, "events").withColumn("generation", F.sum((F.col("event_type") == "signup").cast("int")).over(run))
    return g.withColumn("newest", F.max("generation").over(Window.partitionBy("user_id"))).where("generation = newest").select("user_id", "event_id", "generation")


@query("""with m as (select max(ts) as now from events), l as (select user_id, event_type, max(ts) as seen from events where event_type in ('view', 'click', 'error') group by all),
    a as (select user_id, min(seen) as oldest, count(*) as cameras from l group by 1) select user_id, cameras, round((epoch_us(now) - epoch_us(oldest)) / 1e6::double, 6) as age,
    cameras = 3 and (epoch_us(now) - epoch_us(oldest)) / 1e6::double <= 432000 as fresh from a, m""")
def staleness(spark, sf_dir):
    """Users whose cameras were all seen in the last five days."""
    e = read(spark, sf_dir, "events")
    last = e.where(F.col("event_type").isin("view", "click", "error")).groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    each = last.groupBy("user_id").agg(F.min("seen").alias("oldest"), F.count(F.lit(1)).alias("cameras"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    age = align.seconds(F.col("now")) - align.seconds(F.col("oldest"))
    return each.join(F.broadcast(now)).select("user_id", "cameras", F.round(age, 6).alias("age"), ((F.col("cameras") == 3) & (age <= 432000)).alias("fresh"))


@query("""with s as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
    select user_id, r::int as step, event_id from s where r between 2 and 65""")
def rollback_path(spark, sf_dir):
    """The way back: targets in reverse, the current one left out."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf_dir, "events").withColumn("step", F.row_number().over(w)).where("step between 2 and 65").select("user_id", "step", "event_id")


@query("""with b as (select user_id, event_id, ts, floor(epoch_us(ts) / 1e6::double / 3600) as tick from events) select user_id, tick::bigint as tick, arg_min(event_id, (ts, event_id)) as event_id from b group by 1, 2""")
def multi_rate(spark, sf_dir):
    """The first event of each hourly tick: a slow clock on a fast stream."""
    e = _seconds(spark, sf_dir).withColumn("tick", F.floor(F.col("t") / 3600))
    return e.groupBy("user_id", "tick").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""with s as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from events),
    i as (select *, row_number() over (partition by user_id, segment order by ts, event_id) - 1 as prior_index from s)
    select user_id, event_id, prior_index, prior_index < 8 as aligned, case when prior_index >= 8 then 'prior_exhausted' end as reason from i""")
def align_horizon(spark, sf_dir):
    """Place within a segment against a chunk of 8; beyond it rows are invalid."""
    run = sequence.ordered(["user_id"], ["ts", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    s = read(spark, sf_dir, "events").withColumn("segment", F.sum((F.col("event_type") == "signup").cast("int")).over(run))
    s = s.withColumn("prior_index", F.row_number().over(Window.partitionBy("user_id", "segment").orderBy("ts", "event_id")).cast("long") - 1)
    return s.select("user_id", "event_id", "prior_index", (F.col("prior_index") < 8).alias("aligned"), F.when(F.col("prior_index") >= 8, "prior_exhausted").alias("reason"))


@query("""with a as (select user_id, cast(ts as date) as attempt, arg_max(event_type, (ts, event_id)) as outcome from events group by all),
    n as (select *, sum((outcome = 'purchase')::int) over (partition by user_id order by attempt rows between unbounded preceding and 1 preceding) as done from a)
    select user_id, attempt, outcome, outcome = 'purchase' as saved, coalesce(done, 0)::bigint as episode_number from n""")
def attempt_outcome(spark, sf_dir):
    """The last outcome of each attempt; only saved ones advance the episode number."""
    e = read(spark, sf_dir, "events").withColumn("attempt", F.to_date("ts"))
    a = e.groupBy("user_id", "attempt").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome")).withColumn("saved", F.col("outcome") == "purchase")
    before = Window.partitionBy("user_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("episode_number", F.coalesce(F.sum(F.col("saved").cast("long")).over(before), F.lit(0).cast("long")))
