"""Conversion, timing, set and resume queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.operators import convert

from .bindings import TRAJ, read, spread, sql_conjugate, sql_product, sql_spread, sql_unit, trajectory

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _euler(o: int) -> str:
    c, s = [f"cos(action[{o + i}] / 2)" for i in range(3)], [f"sin(action[{o + i}] / 2)" for i in range(3)]
    return f"[{c[0]} * {c[1]} * {c[2]} + {s[0]} * {s[1]} * {s[2]}, {s[0]} * {c[1]} * {c[2]} - {c[0]} * {s[1]} * {s[2]}, {c[0]} * {s[1]} * {c[2]} + {s[0]} * {c[1]} * {s[2]}, {c[0]} * {c[1]} * {s[2]} - {s[0]} * {s[1]} * {c[2]}]"


NAMES = "lx ly lz lqw lqx lqy lqz lg rx ry rz rqw rqx rqy rqz rg"


@query(f"""with {TRAJ}, h as (select vec_id, action as a, {_euler(4)} as l, {_euler(10)} as r from traj), u as (select vec_id, a, {sql_unit('l')} as l, {sql_unit('r')} as r from h),
    o as (select vec_id, [a[1], a[2], a[3]] || l || [a[13]] || [a[7], a[8], a[9]] || r || [a[14]] as v from u) select vec_id, {sql_spread('v', NAMES)} from o""")
def pose12_convert(spark, sf_dir):
    """Roll, pitch and yaw of two arms as commands."""
    a = F.col("action")
    return trajectory(spark, sf_dir).select("vec_id", *spread(convert.pose12_to_pose16(pose.part(a, 0, 12), pose.at(a, 12), pose.at(a, 13)), NAMES))


@query(f"""with {TRAJ}, h as (select vec_id, action as a, [action[7], action[4], action[5], action[6]] as l, [action[15], action[12], action[13], action[14]] as r from traj),
    o as (select vec_id, [a[1], a[2], a[3]] || {sql_unit('l')} || [a[8]] || [a[9], a[10], a[11]] || {sql_unit('r')} || [a[16]] as v from h) select vec_id, {sql_spread('v', NAMES)} from o""")
def pose16_reorder(spark, sf_dir):
    """Commands whose quaternions come as x, y, z, w."""
    return trajectory(spark, sf_dir).select("vec_id", *spread(convert.pose16_from_xyzw(F.col("action")), NAMES))


@query("""with m as (select doc_id, case when doc_id % 5 = 0 then null else (doc_id % 9) * 2 end as width, lang as rotation from documents)
    select doc_id, case when width is null then 'no_action' when width not in (12, 14, 16) then 'unknown_width' when width = 16 and coalesce(rotation, '') not in ('wxyz', 'xyzw') then 'unknown_rotation' end as reason from m""")
def conversion_reasons(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    width = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 9 * 2)
    return d.select("doc_id", convert.conversion_reason(width, F.col("lang")).alias("reason"))


@query("with m as (select user_id, event_type, avg(case when event_id % 7 = 0 then null else value end) as y from events group by all) select user_id, array_to_string(list(event_type order by y desc nulls last, event_type), ',') as cameras from m group by 1")
def camera_order(spark, sf_dir):
    """Cameras of each user by their mean, NaN left out."""
    e = read(spark, sf_dir, "events").withColumn("y", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    return convert.camera_order(e, ["user_id"], "event_type", "y").select("user_id", F.array_join("cameras", ",").alias("cameras"))


@query("select event_type as stage, round(avg(value), 6) as mean, round(sum(value) / (select sum(value) from events), 8) as share from events group by 1")
def step_timing(spark, sf_dir):
    s = convert.step_timing(read(spark, sf_dir, "events"), "event_type", "value")
    return s.select(F.col("event_type").alias("stage"), F.round("mean", 6).alias("mean"), F.round("share", 8).alias("share"))


@query(f"""with {TRAJ}, r as (select *, lag(state) over (partition by episode order by frame_index) as p from traj), k as (select vec_id, state as s, p, {sql_unit('p[4:7]')} as a, {sql_unit('state[4:7]')} as b from r where p is not null),
    m as (select *, {sql_product(sql_conjugate('a'), 'b')} as q from k), o as (select vec_id, [s[1] - p[1], s[2] - p[2], s[3] - p[3]] || {sql_unit('q')} as d from m) select vec_id, {sql_spread('d', 'x y z qw qx qy qz')} from o""")
def winner_transition(spark, sf_dir):
    """Each recorded state relative to the one before it."""
    w = convert.winner_transitions(trajectory(spark, sf_dir), "state", ["episode"], ["frame_index"])
    return w.select("vec_id", *spread(pose.part(F.col("delta"), 0, 7), "x y z qw qx qy qz"))


@query("select c_mktsegment as task, sum((c_acctbal > 0)::int)::bigint as next_episode from customer group by 1")
def resume_point(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("saved", F.col("c_acctbal") > 0).withColumnRenamed("c_mktsegment", "task")
    return convert.next_episode(c, ["task"], "saved")


@query("""select k, 'union' as op from (select l_partkey as k from lineitem where l_returnflag = 'R' union select p_partkey from part where p_size < 10)
    union all select k, 'intersect' from (select l_partkey as k from lineitem where l_returnflag = 'R' intersect select p_partkey from part where p_size < 10)
    union all select k, 'except' from (select p_partkey as k from part where p_size < 10 except select l_partkey from lineitem where l_returnflag = 'R')""")
def key_sets(spark, sf_dir):
    """Union, intersection and difference of keys."""
    a = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    b = read(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.exceptAll(a.distinct()).distinct()}
    out = None
    for op, df in parts.items():
        df = df.withColumn("op", F.lit(op))
        out = df if out is None else out.unionByName(df)
    return out
