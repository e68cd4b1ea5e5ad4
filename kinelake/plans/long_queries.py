"""Series that no task holds: a whole table as one series, in slices of time; quantiles of large groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import align, resample, sequence, stats

from .bindings import read, rounded, spread, sql_product, sql_spread, sql_unit, trajectory

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _one(spark, sf_dir, kind):
    e = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.lit(0).alias("series"), "ts", "event_id", "value")


@query("""with p as (select ts, event_id from events where event_type = 'purchase'), v as (select ts, max(event_id) as hi, min(event_id) as lo from events where event_type = 'view' group by ts),
    j as (select p.ts, p.event_id, b.ts as bt, b.hi, f.ts as ft, f.lo from p asof left join v b on p.ts >= b.ts asof left join v f on p.ts <= f.ts)
    select event_id, case when bt is not null and (ft is null or ts - bt <= ft - ts) then hi else lo end as near_id from j""")
def nearest_one_series(spark, sf_dir):
    """The view nearest to each purchase over all users: one series, shared by all tasks in slices of time."""
    out = align.asof_nearest(_one(spark, sf_dir, "purchase").drop("value"), _one(spark, sf_dir, "view"), ["series"], "ts", "event_id", ["event_id"], slices=None)
    return out.select("event_id", F.col("r_event_id").alias("near_id"))


@query("""with v as (select epoch_us(ts) / 1e6::double as t, arg_min(value, event_id) as value from events where event_type = 'view' group by 1), g as (select row_number() over (order by ts, event_id) - 1 as k, event_id, epoch_us(ts) / 1e6::double + 1800.0 as t from events where event_type = 'click'),
    j as (select event_id, g.t, a.t as t1, a.value as v1, b.t as t2, b.value as v2 from g asof left join v a on g.t >= a.t asof left join v b on g.t <= b.t)
    select event_id, round(case when t1 is null then v2 when t2 is null or t2 = t1 then v1 else v1 + (v2 - v1) * ((t - t1) / (t2 - t1)) end, 5) + 0.0 as value from j""")
def interp_one_series(spark, sf_dir):
    """A value interpolated half an hour after each click, over the views of all users as one series."""
    v = _one(spark, sf_dir, "view").withColumn("t", align.seconds(F.col("ts")))
    v = resample.prepare_series(v, ["series"], "t", "event_id", ["value"])
    g = _one(spark, sf_dir, "click").select("series", "event_id", (align.seconds(F.col("ts")) + 1800.0).alias("grid_time"))
    return resample.interpolate(g, v, ["series"], "t", "value", "v", slices=None).select("event_id", rounded(F.col("v"), 5).alias("value"))


@query(f"""with recursive u as (select row_number() over (order by vec_id) as k, vec_id, (embedding::double[])[1:16] as a from embeddings), n as (select k, vec_id, a, {sql_unit('a[4:7]')} as lq, {sql_unit('a[12:15]')} as rq from u),
    f as (select k, vec_id, [a[1], a[2], a[3]] as lx, lq, a[8] as lg, [a[9], a[10], a[11]] as rx, rq, a[16] as rg from n where k = 1
      union all
      select n.k, n.vec_id, [f.lx[1] + a[1], f.lx[2] + a[2], f.lx[3] + a[3]], {sql_unit(sql_product('f.lq', 'n.lq'))}, a[8], [f.rx[1] + a[9], f.rx[2] + a[10], f.rx[3] + a[11]], {sql_unit(sql_product('f.rq', 'n.rq'))}, a[16] from f join n on n.k = f.k + 1),
    o as (select vec_id, lx || lq || [lg] || rx || rq || [rg] as d from f) select vec_id, {sql_spread('d', 'lx ly lz lqw lqx lqy lqz lg rx ry rz rqw rqx rqy rqz rg', 4)} from o""")
def decode_one_series(spark, sf_dir):
    """Deltas of all rows decoded as one recording, by an associative scan over runs, slices and the series."""
    t = trajectory(spark, sf_dir).withColumn("series", F.lit(0))
    out = sequence.decode_long(t, "action", ["series"], ["vec_id"], [])
    return out.select("vec_id", *spread(F.col("decoded"), "lx ly lz lqw lqx lqy lqz lg rx ry rz rqw rqx rqy rqz rg", 4))


@query("""with x as (select l_returnflag, l_extendedprice::double as x from lineitem), s as (select unnest([0.01, 0.5, 0.99]) as share)
    select l_returnflag, share::double as share, round(quantile_cont(x, 0.01), 4) as value from x, s where share = 0.01 group by 1, 2
    union all select l_returnflag, share::double, round(quantile_cont(x, 0.5), 4) from x, s where share = 0.5 group by 1, 2
    union all select l_returnflag, share::double, round(quantile_cont(x, 0.99), 4) from x, s where share = 0.99 group by 1, 2""")
def quantiles_refined(spark, sf_dir):
    """Quantiles of prices by flag: brackets narrowed by sketches and counted, at most 1,024 values in a buffer."""
    x = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x"))
    out = stats.exact_quantiles(x, ["l_returnflag"], "x", [0.01, 0.5, 0.99], held=1024)
    return out.select("l_returnflag", "share", rounded(F.col("value"), 4).alias("value"))
