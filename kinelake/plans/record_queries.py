"""Queries on recordings: clocks, cameras, histories, layouts, draws, and the stores' own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import layout, pose
from kinelake.operators import align, joins, records, resample, windows
from kinelake.sources import codecs, pairs, repos

from .bindings import TRAJ, read, rounded, spread, sql_product, sql_spread, sql_unit, trajectory
from .source_queries import workspace
from .window_queries import KEYFRAMES, _kept, texts

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _draw(seed: str, slot: str, size: str) -> str:
    return f"(('0x' || substr(md5(({seed})::varchar || ':' || ({slot})::varchar), 1, 8))::bigint % {size})"


CLOCKS = """e as (select *, row_number() over w as k, epoch_us(ts) // 1000000 as s, (epoch_us(ts) % 1000000) * 1000 as ns from events window w as (partition by user_id order by ts, event_id)),
    c as (select *, case when user_id % 3 = 0 then s + ns / 1e9::double end as native, case when user_id % 3 = 1 or k > 2 then value end as parquet from e)"""


@query(f"""with {CLOCKS}, n as (select *, count(native) over p as a, count(parquet) over p as b, count(*) over p as n from c window p as (partition by user_id)),
    o as (select *, case when a = n then native - first_value(native) over w when b = n then parquet - first_value(parquet) over w else (k - 1) / 30.0::double end as t from n window w as (partition by user_id order by ts, event_id))
    select user_id, event_id, case when a = n then 0 when b = n then 1 else 2 end as clock, round(t, 4) + 0.0 as time from o""")
def clock_choice(spark, sf_dir):
    """Native seconds and nanoseconds, else a stored stamp, else the frame rate; from 0."""
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    k = F.row_number().over(windows.ordered(["user_id"], ["ts", "event_id"]))
    native = F.when(F.col("user_id") % 3 == 0, F.floor(F.col("us") / 1000000) + F.pmod("us", F.lit(1000000)) * 1000 / F.lit(1e9))
    stored = F.when((F.col("user_id") % 3 == 1) | (F.col("k") > 2), F.col("value"))
    out = records.choose_time(e.withColumn("k", k), ["user_id"], ["ts", "event_id"], [native, stored], 30.0)
    return out.select("user_id", "event_id", "clock", rounded(F.col("time"), 4).alias("time"))


@query("""with s as (select l_orderkey as episode, l_linenumber, l_partkey, l_quantity, case when l_orderkey % 3 <> 0 then l_extendedprice end as a, case when l_orderkey % 2 = 0 or l_linenumber <> 2 then l_discount end as b from lineitem),
    n as (select *, bool_and(a is not null) over p as ha, bool_and(b is not null) over p as hb from s window p as (partition by episode))
    select episode, l_linenumber, l_partkey, case when ha and hb then 0 when hb then 2 else 3 end as tier, round(case when ha and hb then a when hb then b else l_quantity end, 4) + 0.0 as first from n""")
def action_tiers(spark, sf_dir):
    """Actions from the first tier of columns that a recording has throughout."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_extendedprice")).alias("a"), F.when((F.col("l_orderkey") % 2 == 0) | (F.col("l_linenumber") != 2), F.col("l_discount")).alias("b"))
    out = records.first_complete(li, [["a", "b"], ["a", "absent"], ["b"], ["l_quantity"]], ["episode"])
    return out.select("episode", "l_linenumber", "l_partkey", "tier", rounded(F.get("action", F.lit(0)), 4).alias("first"))


@query("""with c as (select distinct user_id, case event_type when 'view' then 'left' when 'click' then 'wrist_left' when 'error' then 'right' when 'signup' then 'wrist_right' else 'head' end as camera from events where value < 6),
    h as (select user_id, bool_or(camera = 'left') l, bool_or(camera = 'wrist_left') wl, bool_or(camera = 'right') r, bool_or(camera = 'wrist_right') wr from c group by 1)
    select * from (select user_id, 'left_wrist' as role, case when wl then 'wrist_left' when l then 'left' end as camera from h union all select user_id, 'left_main', case when wl and l then 'left' end from h
      union all select user_id, 'right_wrist', case when wr then 'wrist_right' when r then 'right' end from h union all select user_id, 'right_main', case when wr and r then 'right' end from h) where camera is not null""")
def camera_roles(spark, sf_dir):
    kind = F.col("event_type")
    camera = F.when(kind == "view", "left").when(kind == "click", "wrist_left").when(kind == "error", "right").when(kind == "signup", "wrist_right").otherwise("head")
    return records.camera_roles(read(spark, sf_dir, "events").where("value < 6").select("user_id", camera.alias("camera")), ["user_id"])


@query("""with e as (select user_id, event_id, ts, case when event_id % 4 = 0 then value end as image from events),
    f as (select user_id, min_by(image, (ts, event_id)) as f from e where image is not null group by 1)
    select e.user_id, e.event_id, coalesce(last_value(image ignore nulls) over (partition by e.user_id order by e.ts, e.event_id rows unbounded preceding), f.f) as image from e left join f using (user_id)""")
def camera_fallback(spark, sf_dir):
    """Cameras without an image show the one before them, or else the first."""
    e = read(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    return records.carried_camera(e, "raw", ["user_id"], ["ts", "event_id"], "image").select("user_id", "event_id", "image")


@query(f"""with {TRAJ}, c as (select user_id % 10 as episode, event_type as camera, count(*) as frames from events where event_type in ('view', 'click') group by all),
    d as (select episode, min(frames) as frames from c group by 1 having count(*) = 2), n as (select episode, count(*) as n from traj group by 1)
    select episode as episode_index, least(n, frames) as end_frame from n join d using (episode) where least(n, frames) - 3 >= 16""")
def clip_eligible(spark, sf_dir):
    """Segments long enough for a window of episodes with both cameras, cut to the shortest."""
    n = trajectory(spark, sf_dir).groupBy(F.col("episode").alias("episode_index")).agg(F.count(F.lit(1)).alias("length"))
    seg = n.withColumn("start_frame", F.lit(3).cast("long")).withColumn("end_frame", F.col("length"))
    cameras = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("episode_index"), F.col("event_type").alias("camera")).agg(F.count(F.lit(1)).alias("frames"))
    return repos.eligible(seg, 16, cameras, ["view", "click"]).select("episode_index", "end_frame")


@query(f"with {TRAJ} select vec_id, round(action[3], 6) + 0.0 as lz, round(action[8], 6) + 0.0 as lg, round(action[9], 6) + 0.0 as rx, round(action[16], 6) + 0.0 as rg, round(list_sum(action), 5) + 0.0 as back from traj")
def action_split(spark, sf_dir):
    """A command by arm, and put together again."""
    t = trajectory(spark, sf_dir).withColumn("p", pose.split16(F.col("action")))
    back = F.aggregate(pose.assemble16(F.col("p")), F.lit(0.0), lambda s, x: s + x)
    return t.select("vec_id", rounded(pose.at(F.col("p.left_pose"), 2)).alias("lz"), rounded(F.col("p.left_gripper")).alias("lg"), rounded(pose.at(F.col("p.right_pose"), 0)).alias("rx"), rounded(F.col("p.right_gripper")).alias("rg"), rounded(back, 5).alias("back"))


RELEASE = "dx dy dz qw qx qy qz"


@query(f"""with {TRAJ}, u as (select vec_id, action as a, state as s, {sql_unit('[action[12], -action[13], -action[14], -action[15]]')} as p, {sql_unit('state[12:15]')} as q from traj), m as (select *, {sql_product('p', 'q')} as r from u),
    o as (select vec_id, a, [s[9] - a[9], s[10] - a[10], s[11] - a[11]] || {sql_unit('r')} as d from m)
    select vec_id, round(a[1], 6) + 0.0 as c0, round(a[8], 6) + 0.0 as c28, {sql_spread('d', RELEASE)}, 16 + 7 * (vec_id % 2 = 0)::int + 7 * (vec_id % 3 = 0)::int as known from o""")
def release_channels(spark, sf_dir):
    """Release poses relative to the command, in channels of their own with a mask."""
    v, mask = pose.release30(F.col("action"), F.col("action"), F.col("state"), F.col("vec_id") % 2 == 0, F.col("vec_id") % 3 == 0)
    t = trajectory(spark, sf_dir).withColumn("v", v).withColumn("m", mask)
    return t.select("vec_id", rounded(pose.at(F.col("v"), 0)).alias("c0"), rounded(pose.at(F.col("v"), 28)).alias("c28"), *spread(F.slice("v", 22, 7), RELEASE), F.size(F.filter("m", lambda x: x)).alias("known"))


@query(f"""with {TRAJ}, {KEYFRAMES}, n as (select episode, frame_index, row_number() over (partition by episode order by frame_index) - 1 as pos from kept),
    h as (select a.episode, a.frame_index, list(b.frame_index order by b.pos) filter (b.pos is not null) as h from n a left join n b on a.episode = b.episode and b.pos < a.pos and b.pos >= a.pos - 6 and (a.pos - b.pos) % 2 = 0 group by all)
    select episode, frame_index, array_to_string([-1 for i in range(0, 3 - coalesce(len(h), 0))] || coalesce(h, []), ',') as history from h""")
def kept_history(spark, sf_dir):
    """Every second one of the kept frames before a kept frame."""
    h = windows.kept_history(_kept(spark, sf_dir), "frame_index", 2, 3, ["episode"], F.lit(-1).cast("long"))
    return h.select("episode", "frame_index", texts(F.col("history")).alias("history"))


@query("""with l as (select o_custkey, list(distinct o_orderkey order by o_orderkey) as k from orders group by 1), d as (select *, [k[i + 1] - k[i] for i in range(1, len(k))] as d from l)
    select o_custkey, case when len(d) > 0 and list_min(d) = list_max(d) then list_min(d) end as step from d""")
def uniform_stride(spark, sf_dir):
    """The stride of each customer's order numbers, if there is one."""
    k = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("k"))
    return k.select("o_custkey", F.when(F.size("k") > 1, windows.uniform_step(F.col("k"))).alias("step"))


@query("select event_id, least(greatest(floor((event_id % 1007) / 1000.0::double * 1000)::bigint, 0), 999) as timestep from events")
def timestep_sample(spark, sf_dir):
    u = (F.col("event_id") % 1007) / F.lit(1000.0)
    return read(spark, sf_dir, "events").select("event_id", layout.sample_timestep(u, 1000).cast("long").alias("timestep"))


@query("select r_regionkey, f::int as f, h::int as h, w::int as w, (f * 12 + h * 4 + w)::int as place from region, range(0, 2) a(f), range(0, 3) b(h), range(0, 4) c(w)")
def grid_cells(spark, sf_dir):
    """Every cell of a grid, in order."""
    cells = read(spark, sf_dir, "region").select("r_regionkey", F.posexplode(layout.grid_ids(2, 3, 4)).alias("place", "cell"))
    return cells.select("r_regionkey", "cell.f", "cell.h", "cell.w", "place")


@query(f"""with n as (select *, row_number() over (order by s_suppkey) - 1 as number, count(*) over () as size from supplier), s as (select rank, slot, {_draw('7 + rank * 100003', 'slot', '(select count(*) from supplier)')} as number from range(0, 4) r(rank), range(0, 50) t(slot))
    select rank, slot::int as slot, s_suppkey from s join n using (number)""")
def rank_draw(spark, sf_dir):
    """50 suppliers with replacement for each of four ranks."""
    return records.rank_draws(read(spark, sf_dir, "supplier"), ["s_suppkey"], 4, 50, 7).select("rank", "slot", "s_suppkey")


@query(f"""with n as (select *, row_number() over (order by p_partkey) - 1 as number from part), t as (select slot, attempt, {_draw('11', 'slot * 20 + attempt', '(select count(*) from part)')} as number from range(0, 100) s(slot), range(0, 20) a(attempt)),
    g as (select slot, attempt, p_partkey, row_number() over (partition by slot order by attempt) as r from t join n using (number) where p_size <= 10)
    select slot, attempt::int as attempt, p_partkey from g where r = 1""")
def retried_draw(spark, sf_dir):
    """A valid part for each slot, after up to 20 draws."""
    return records.retried_draws(read(spark, sf_dir, "part"), ["p_partkey"], F.col("p_size") <= 10, 100, 11).select("slot", "attempt", "p_partkey")


@query("select event_id // 32 as batch, event_type as dataset, array_to_string(list(event_id order by event_id), ',') as positions from events group by all")
def dataset_groups(spark, sf_dir):
    """Each dataset's rows of a mixed batch."""
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 32).alias("batch"), F.col("event_type").alias("dataset"), "event_id")
    return records.by_dataset(e, ["batch"], "dataset", "event_id").select("batch", "dataset", texts(F.col("positions")).alias("positions"))


@query("with o as (select l_returnflag, l_linenumber, avg(l_quantity) as v from lineitem group by all) select l_returnflag, round(avg(v), 6) as mean, round(max(v), 6) as max, count(*) as ranks from o group by 1")
def rank_reduce(spark, sf_dir):
    """Mean and maximum over ranks."""
    out = records.rank_reduce(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity")
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"), "ranks")


@query(f"with {TRAJ}, n as (select *, count(*) over (partition by episode) // 4 as frames from traj) select vec_id, c::int as channel, ((c * frames + frame_index // 4) * 4 + frame_index % 4)::bigint as place, round(action[c + 1], 6) + 0.0 as value from n, range(0, 3) r(c) where frame_index < frames * 4")
def layout_fold(spark, sf_dir):
    """Rows of frames in groups of four as channel, frame, place in the frame."""
    t = trajectory(spark, sf_dir)
    t = t.join(t.groupBy("episode").agg(F.floor(F.count(F.lit(1)) / 4).alias("frames")), "episode").where("frame_index < frames * 4")
    each = t.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return each.select("vec_id", "channel", records.folded_place(F.col("frame_index"), F.col("channel"), F.col("frames"), 4).alias("place"), rounded(F.expr("action[channel]")).alias("value"))


@query("""with c as (select user_id, event_type, case event_type when 'view' then 'high' when 'click' then 'right_in_crop' when 'error' then 'left_arm' when 'signup' then 'right_arm' else 'left_right_in_crop' end as camera, min(event_id) as position from events group by all),
    k as (select *, case when camera = 'high' then 2 when contains(camera, 'right_in_') then 0 else 1 end as kind from c)
    select user_id, camera, (dense_rank() over (partition by user_id order by kind) - 1)::int as "row", (row_number() over (partition by user_id, kind order by position) - 1)::int as "column" from k""")
def latent_places(spark, sf_dir):
    """Crops over arms over the main camera."""
    kind = F.col("event_type")
    camera = F.when(kind == "view", "high").when(kind == "click", "right_in_crop").when(kind == "error", "left_arm").when(kind == "signup", "right_arm").otherwise("left_right_in_crop")
    parts = read(spark, sf_dir, "events").groupBy("user_id", camera.alias("camera")).agg(F.min("event_id").alias("position"))
    return records.concat_places(parts, ["user_id"], "camera", "high").select("user_id", "camera", "row", "column")


@query("select 'delta' as representation, count(*) as n from region")
def representation_check(spark, sf_dir):
    """The one representation that all entries of a manifest have."""
    m = read(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") % 2 == 0, " Delta").otherwise("delta").alias("representation"))
    return records.same_representation(m, "representation").join(F.broadcast(m.agg(F.count(F.lit(1)).alias("n"))))


@query("""with c as (select r_name as name, r_regionkey < 3 as ok from region) select bool_and(ok) as ok, string_agg(name, ',' order by name) filter (not ok) as failed from c""")
def preflight_checks(spark, sf_dir):
    """Whether every check holds, and which do not."""
    checks = read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") < 3).alias("ok"), F.lit("").alias("detail"))
    return repos.preflight(checks).select("ok", texts(F.col("failed")).alias("failed"))


@query("with r as (select s_suppkey, row_number() over (order by s_acctbal desc, s_name desc) as r from supplier) select s_suppkey from r where r > 3")
def checkpoint_retention(spark, sf_dir):
    """All but the newest three of a listing."""
    listing = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("path"), F.col("s_acctbal").alias("modified"))
    return repos.stale_checkpoints(listing, 3).select("s_suppkey")


@query(f"""with {TRAJ}, n as (select *, lead(state) over w as s1, count(*) over (partition by episode) as n from traj window w as (partition by episode order by frame_index))
    select 'column' as kind, 'task ' || episode as instruction, frame_index, round(state[1], 6) + 0.0 as s, round(action[1], 6) + 0.0 as a from n
    union all select 'next_state', 'task ' || episode, frame_index, round(state[1], 6) + 0.0, round(coalesce(s1, state)[1], 6) + 0.0 from n
    union all select 'paired', 'task ' || episode, frame_index, round(state[1], 6) + 0.0, round(s1[1], 6) + 0.0 from n where s1 is not null""")
def container_layouts(spark, sf_dir):
    """One container for each episode, read by three layouts: own actions, the state after, and pairs of states."""
    path = workspace(spark)
    rows = F.array_sort(F.collect_list(F.struct("frame_index", "state", "action")))
    whole = trajectory(spark, sf_dir).groupBy("episode").agg(rows.alias("r"))
    files = whole.select(F.col("r.state").alias("state"), F.col("r.action").alias("action"), F.array(F.concat(F.lit("task "), F.col("episode").cast("string"))).alias("texts"))
    files.write.option("maxRecordsPerFile", "1").json(path)
    out = None
    for kind in ("column", "next_state", "paired"):
        shape = codecs.Layout(kind, ".json", ("state",), ("action",), action=kind, text=("texts",))
        part = codecs.read_layout(spark, path, shape).select(F.lit(kind).alias("kind"), "instruction", "frame_index", rounded(F.get("state", F.lit(0))).alias("s"), rounded(F.get("action", F.lit(0))).alias("a"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""with t as (select o_orderkey, o_custkey, 'Clerk/' || (o_orderkey % 40) as file from orders), r as (select s_suppkey as episode, 'x/' || (s_suppkey % 25) as path, s_suppkey as id from supplier where s_suppkey <= 10),
    b as (select split_part(path, '/', -1) as base, min(episode) as episode from r group by 1)
    select o_orderkey, coalesce(b.episode, r.episode) as source from t left join b on b.base = split_part(t.file, '/', -1) left join r on r.id = t.o_custkey""")
def source_reuse(spark, sf_dir):
    """A source episode by its file's base name, or else by its number."""
    t = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("Clerk/"), (F.col("o_orderkey") % 40).cast("string")).alias("file"))
    r = read(spark, sf_dir, "supplier").where("s_suppkey <= 10").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("x/"), (F.col("s_suppkey") % 25).cast("string")).alias("path"))
    t, r = t.withColumn("base", F.element_at(F.split("file", "/"), -1)), r.withColumn("base_of", F.element_at(F.split("path", "/"), -1)).withColumn("episode", F.col("id"))
    return joins.lookup(t, r, ["base", "o_custkey"], ["base_of", "id"], "episode", "source").select("o_orderkey", "source")


@query(f"with {TRAJ}, t as (select distinct episode, 'task ' || (episode % 3) as task from traj) select task, array_to_string(list(episode order by episode), ',') as episodes from t group by 1")
def episodes_by_task(spark, sf_dir):
    """The episodes of each task's repository."""
    t = trajectory(spark, sf_dir).select(F.concat(F.lit("task "), (F.col("episode") % 3).cast("string")).alias("task"), "episode").distinct()
    return records.by_dataset(t, [], "task", "episode").select("task", texts(F.col("positions")).alias("episodes"))


@query("""with v as (select user_id, event_id, epoch_us(ts) / 1e6::double as t, value from events), g as (select user_id, unnest(range(0, 20)) as k, min(t) as s from v group by user_id),
    q as (select user_id, k, s + k * 43200.0::double as t from g),
    a as (select user_id, t, value from v where event_id % 2 = 0), b as (select user_id, t, value from v where event_id % 2 = 1),
    j as (select q.user_id, q.k, q.t, a1.t as t1, a1.value as v1, a2.t as t2, a2.value as v2, b1.t as t3, b1.value as v3, b2.t as t4, b2.value as v4 from q asof left join a a1 on q.user_id = a1.user_id and q.t >= a1.t asof left join a a2 on q.user_id = a2.user_id and q.t <= a2.t
      asof left join b b1 on q.user_id = b1.user_id and q.t >= b1.t asof left join b b2 on q.user_id = b2.user_id and q.t <= b2.t)
    select user_id, k as frame_index, round(case when t1 is null then v2 when t2 is null or t2 = t1 then v1 else v1 + (v2 - v1) * ((t - t1) / (t2 - t1)) end, 5) + 0.0 as "left", round(case when t3 is null then v4 when t4 is null or t4 = t3 then v3 else v3 + (v4 - v3) * ((t - t3) / (t4 - t3)) end, 5) + 0.0 as "right" from j""")
def two_arm_resample(spark, sf_dir):
    """Both arms, each by a clock of its own, on one grid."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", align.seconds(F.col("ts")).alias("t"), "value")
    g = e.groupBy("user_id").agg(F.min("t").alias("s")).withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("grid_time", F.col("s") + F.col("frame_index") * 43200.0)
    g = g.select("user_id", F.col("frame_index").cast("long").alias("frame_index"), "grid_time")
    out = resample.interpolate(g, e.where("event_id % 2 = 0"), ["user_id"], "t", "value", "left")
    out = resample.interpolate(out, e.where("event_id % 2 = 1"), ["user_id"], "t", "value", "right")
    return out.select("user_id", "frame_index", rounded(F.col("left"), 5).alias("left"), rounded(F.col("right"), 5).alias("right"))
