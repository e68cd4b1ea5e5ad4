"""Resampling queries on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.operators import align, resample

from .bindings import TRAJ, read, rounded, spread, sql_spread, sql_unit, trajectory

QUERIES, ORACLE = {}, {}
HOUR = 3600.0
FPS = 1 / 21600.0  # one row in six hours


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def samples(spark, sf_dir, kind=None):
    e = read(spark, sf_dir, "events")
    e = e if kind is None else e.where(F.col("event_type") == kind)
    return e.select("user_id", "event_id", "event_type", "value", align.seconds(F.col("ts")).alias("t"))


GRID = """ev as (select user_id, event_id, event_type, value, epoch_us(ts) / 1e6::double as t from events),
    sp as (select user_id, min(t) as s, max(t) as e from ev group by 1 having max(t) > min(t)),
    gr as (select user_id, unnest(range(0, greatest(1, floor((e - s) * (1::double / 21600.0::double))::bigint + 1))) as frame_index, s from sp),
    g as (select user_id, frame_index, s + frame_index / (1::double / 21600.0::double) as t from gr)"""


def grid(spark, sf_dir):
    span = samples(spark, sf_dir).groupBy("user_id").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    return resample.uniform_grid(span, "s", "e", FPS).select("user_id", "frame_index", "grid_time")


@query("""select user_id, event_type, t, value from (select user_id, event_type, floor(epoch_us(ts) / 1e6::double / 3600) as t, value,
    row_number() over (partition by user_id, event_type, floor(epoch_us(ts) / 1e6::double / 3600) order by event_id) as r from events where isfinite(value)) where r = 1""")
def prepare_series(spark, sf_dir):
    """Finite samples; the first one of each hour stamp."""
    s = samples(spark, sf_dir).withColumn("t", F.floor(F.col("t") / HOUR).cast("double"))
    return resample.prepare_series(s, ["user_id", "event_type"], "t", "event_id", ["value"]).select("user_id", "event_type", "t", "value")


@query(f"with {GRID} select user_id, frame_index, round(t, 3) as grid_time from g")
def uniform_grid(spark, sf_dir):
    return grid(spark, sf_dir).select("user_id", "frame_index", F.round("grid_time", 3).alias("grid_time"))


@query(f"""with {GRID}, v as (select * from ev where event_type = 'view'),
    j as (select g.user_id, g.frame_index, g.t, b.t as bt, b.value as bv, f.t as ft, f.value as fv from g asof left join v b on g.user_id = b.user_id and g.t >= b.t asof left join v f on g.user_id = f.user_id and g.t <= f.t)
    select user_id, frame_index, round(case when bt is null then fv when ft is null or ft = bt then bv else bv + (fv - bv) * ((t - bt) / (ft - bt)) end, 6) + 0.0 as value from j""")
def interp_linear(spark, sf_dir):
    """The view signal on each user's grid; ends hold."""
    out = resample.interpolate(grid(spark, sf_dir), samples(spark, sf_dir, "view"), ["user_id"], "t", "value", "value")
    return out.select("user_id", "frame_index", rounded(F.col("value")).alias("value"))


@query(f"""with {GRID}, v as (select * from ev where event_type = 'view'),
    j as (select g.user_id, g.frame_index, g.t, b.t as bt, b.event_id as bv, f.t as ft, f.event_id as fv from g asof left join v b on g.user_id = b.user_id and g.t >= b.t asof left join v f on g.user_id = f.user_id and g.t <= f.t)
    select user_id, frame_index, case when bt is not null and (ft is null or t - bt <= ft - t) then bv else fv end as event_id from j""")
def nearest_frame(spark, sf_dir):
    """The view nearest to each grid point."""
    out = resample.nearest_index(grid(spark, sf_dir), samples(spark, sf_dir, "view"), ["user_id"], "t", "event_id", "event_id")
    return out.select("user_id", "frame_index", "event_id")


@query(f"""with {TRAJ}, s as (select episode, frame_index * 1.0::double as t, {sql_unit('action[4:7]', False)} as q from traj), n as (select episode, max(t) as e from s group by 1),
    g as (select episode, unnest(range(0, floor(e * 2.5::double)::bigint + 1)) as k from n), h as (select episode, k, k / 2.5::double as t from g),
    j as (select h.episode, h.k, h.t, b.t as bt, b.q as a, f.t as ft, case when list_dot_product(b.q, f.q) < 0 then [-e for e in f.q] else f.q end as b, abs(list_dot_product(b.q, f.q)) as c
      from h asof left join s b on h.episode = b.episode and h.t >= b.t asof left join s f on h.episode = f.episode and h.t <= f.t),
    w as (select *, (t - bt) / (ft - bt) as u, acos(least(c, 1.0)) as th from j),
    l as (select *, [a[i] + u * (b[i] - a[i]) for i in range(1, 5)] as lin, [(sin((1 - u) * th) * a[i] + sin(u * th) * b[i]) / sin(th) for i in range(1, 5)] as arc from w),
    o as (select episode, k, case when bt = ft then a when c > 0.9995 then {sql_unit('lin', False)} else arc end as q from l)
    select episode, k as frame_index, {sql_spread('q', 'qw qx qy qz')} from o""")
def slerp_resample(spark, sf_dir):
    """Rotations of each episode at 2.5 times their rate."""
    s = trajectory(spark, sf_dir).select("episode", F.col("frame_index").cast("double").alias("t"), pose.part(F.col("action"), 3, 4).alias("q"))
    span = s.groupBy("episode").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    g = resample.uniform_grid(span, "s", "e", 2.5).select("episode", "frame_index", "grid_time")
    out = resample.interpolate_rotation(g, s, ["episode"], "t", "q", "q")
    return out.select("episode", "frame_index", *spread(F.col("q"), "qw qx qy qz"))


@query("""select user_id, event_id, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6::double, 3) + 0.0 as rel from events""")
def rebase_time(spark, sf_dir):
    """Time since each user's first event."""
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))  # whole microseconds: no digit is lost
    return resample.rebase(e, "us", ["user_id"], "rel").select("user_id", "event_id", rounded(F.col("rel") / F.lit(1e6), 3).alias("rel"))


def two_clock_resample(spark, sf_dir):
    """State and command clocks of a user on their common grid: state linear, command by the nearest earlier or later sample."""
    state, command = samples(spark, sf_dir, "signup"), samples(spark, sf_dir, "purchase")
    both = state.unionByName(command)
    w = align.common_window(both, ["user_id"], "event_type", "t", 2).where("valid")
    g = resample.uniform_grid(w, "starts_at", "ends_at", FPS).select("user_id", "frame_index", "grid_time")
    out = resample.interpolate(g, state, ["user_id"], "t", "value", "state")
    out = resample.interpolate(out, command, ["user_id"], "t", "value", "command")
    return out.select("user_id", "frame_index", rounded(F.col("state")).alias("state"), rounded(F.col("command")).alias("command"))


QUERIES["two_clock_resample"] = two_clock_resample
_clock = lambda name, kind: f"""{name} as (select user_id, epoch_us(ts) / 1e6::double as t, value from events where event_type = '{kind}')"""
_at = lambda b, f: f"case when {b}.t is null then {f}.value when {f}.t is null or {f}.t = {b}.t then {b}.value else {b}.value + ({f}.value - {b}.value) * ((g.t - {b}.t) / ({f}.t - {b}.t)) end"
ORACLE["two_clock_resample"] = f"""with {_clock('s', 'signup')}, {_clock('c', 'purchase')},
    w as (select s.user_id, greatest(s.a, c.a) as lo, least(s.b, c.b) as hi from (select user_id, min(t) a, max(t) b from s group by 1) s join (select user_id, min(t) a, max(t) b from c group by 1) c using (user_id)),
    gr as (select user_id, lo, unnest(range(0, greatest(1, floor((hi - lo) * (1::double / 21600.0::double))::bigint + 1))) as k from w where hi > lo),
    g as (select user_id, k, lo + k / (1::double / 21600.0::double) as t from gr)
    select g.user_id, g.k as frame_index, round({_at('s1', 's2')}, 6) + 0.0 as state, round({_at('c1', 'c2')}, 6) + 0.0 as command
    from g asof left join s s1 on g.user_id = s1.user_id and g.t >= s1.t asof left join s s2 on g.user_id = s2.user_id and g.t <= s2.t
    asof left join c c1 on g.user_id = c1.user_id and g.t >= c1.t asof left join c c2 on g.user_id = c2.user_id and g.t <= c2.t"""
