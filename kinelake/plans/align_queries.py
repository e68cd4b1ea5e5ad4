"""Alignment queries on the ``events`` table: purchases are commands, views, clicks and errors are cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import align, sequence

from .bindings import read

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def of_type(spark, sf_dir, kind):
    return read(spark, sf_dir, "events").where(F.col("event_type") == kind)


def _gap(a: str, b: str):
    return F.round(align.seconds(F.col(a)) - align.seconds(F.col(b)), 6) + F.lit(0.0)


@query("""
    with p as (select user_id, ts, event_id from events where event_type = 'purchase'),
    v as (select user_id, ts, event_id, value from events where event_type = 'view')
    select p.user_id, p.event_id, v.event_id as view_id, v.value as view_value,
           round((epoch_us(v.ts) / 1e6::double) - (epoch_us(p.ts) / 1e6::double), 6) as offset_s
    from p asof join v on p.user_id = v.user_id and p.ts >= v.ts""")
def asof_causal(spark, sf_dir):
    """The newest view at or before each purchase, and how old it is."""
    left = of_type(spark, sf_dir, "purchase").select("user_id", "ts", "event_id")
    right = of_type(spark, sf_dir, "view").select("user_id", "ts", "event_id", "value")
    out = align.asof(left, right, ["user_id"], "ts", "event_id", ["event_id", "value"])
    return out.where("r_ts is not null").select("user_id", "event_id", F.col("r_event_id").alias("view_id"), F.col("r_value").alias("view_value"), _gap("r_ts", "ts").alias("offset_s"))


NEAREST = """select l.user_id, l.event_id, case when b.ts is not null and (f.ts is null or l.ts - b.ts <= f.ts - l.ts) then b.event_id else f.event_id end as near_id,
           case when b.ts is not null and (f.ts is null or l.ts - b.ts <= f.ts - l.ts) then b.ts else f.ts end as near_ts, l.ts
    from {l} l asof left join {r} b on l.user_id = b.user_id and l.ts >= b.ts asof left join {r} f on l.user_id = f.user_id and l.ts <= f.ts"""


@query(f"""
    with p as (select user_id, ts, event_id from events where event_type = 'purchase'),
    v as (select user_id, ts, event_id from events where event_type = 'view'), n as ({NEAREST.format(l='p', r='v')})
    select user_id, event_id, near_id, round((epoch_us(near_ts) / 1e6::double) - (epoch_us(ts) / 1e6::double), 6) + 0.0 as offset_s from n where near_id is not null""")
def asof_nearest(spark, sf_dir):
    """The view nearest to each purchase; the earlier one wins a tie."""
    left = of_type(spark, sf_dir, "purchase").select("user_id", "ts", "event_id")
    right = of_type(spark, sf_dir, "view").select("user_id", "ts", "event_id")
    out = align.asof_nearest(left, right, ["user_id"], "ts", "event_id", ["event_id"])
    return out.where("r_ts is not null").select("user_id", "event_id", F.col("r_event_id").alias("near_id"), _gap("r_ts", "ts").alias("offset_s"))


@query("""
    select user_id, event_id, (select min_by(e2.event_id, (e2.ts, e2.event_id)) from events e2
        where e2.user_id = e.user_id and e2.event_type = 'error' and (e2.ts, e2.event_id) >= (e.ts, e.event_id)) as next_error from events e""")
def next_event(spark, sf_dir):
    """The first error at or after each event of its user."""
    e = read(spark, sf_dir, "events").withColumn("is_error", F.col("event_type") == "error")
    return sequence.next_marked(e, "is_error", "event_id", ["user_id"], ["ts", "event_id"], "next_error").select("user_id", "event_id", "next_error")


@query(f"""
    with v as (select user_id, ts, event_id from events where event_type = 'view'), c as (select user_id, ts, event_id from events where event_type = 'click'),
    e as (select user_id, ts, event_id from events where event_type = 'error'),
    n1 as ({NEAREST.format(l='v', r='c')}), n2 as ({NEAREST.format(l='v', r='e')}),
    j as (select n1.user_id, n1.event_id, n1.near_id as click_tie, n2.near_id as error_tie, n1.ts as t0, n1.near_ts as t1, n2.near_ts as t2 from n1 join n2 using (event_id)
          where n1.near_id is not null and n2.near_id is not null),
    s as (select *, epoch_us(greatest(t0, t1, t2)) / 1e6::double as hi, epoch_us(least(t0, t1, t2)) / 1e6::double as lo from j)
    select user_id, event_id, click_tie, error_tie, round(hi - lo, 6) + 0.0 as skew, round(hi, 6) as stamp from s where hi - lo <= 21600""")
def nway_sync(spark, sf_dir):
    """Views with the nearest click and error, all within six hours."""
    cut = lambda kind: of_type(spark, sf_dir, kind).select("user_id", "ts", "event_id")
    out = align.nway_sync([("view", cut("view")), ("click", cut("click")), ("error", cut("error"))], ["user_id"], "ts", "event_id", 21600.0)
    return out.select("user_id", "event_id", "click_tie", "error_tie", (F.round("skew", 6) + F.lit(0.0)).alias("skew"), F.round(align.seconds(F.col("stamp")), 6).alias("stamp"))


@query("""
    with e as (select user_id, event_type, min(ts) as f, max(ts) as l from events group by all),
    w as (select user_id, max(f) as s, min(l) as e, count(*) as series from e group by user_id)
    select user_id, epoch_us(s) / 1e6::double as starts, epoch_us(e) / 1e6::double as ends, series, (series = 5 and e > s) as valid from w""")
def common_window(spark, sf_dir):
    """The time that all five channels of a user cover."""
    w = align.common_window(read(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", 5)
    return w.select("user_id", align.seconds(F.col("starts_at")).alias("starts"), align.seconds(F.col("ends_at")).alias("ends"), "series", "valid")


@query("""
    with q as (select row_number() over () as request, l_orderkey as o_orderkey, (l_orderkey % 50) as want from lineitem where l_linenumber % 2 = 0), f as (select l_orderkey, cast(floor(l_quantity) as bigint) as file_end from lineitem),
    n as (select *, count(*) over (partition by l_orderkey) as files from f),
    j as (select q.request, q.o_orderkey, q.want, n.file_end, case when n.file_end = want then 0 when files = 1 then 1 when n.file_end > want then 2 else 3 end as tier,
          case when n.file_end >= want then n.file_end else -n.file_end end as near from q left join n on n.l_orderkey = q.o_orderkey),
    r as (select *, row_number() over (partition by request order by tier, near) as k from j)
    select o_orderkey, want, file_end, case when file_end is not null then tier end::int as tier from r where k = 1""")
def resolve_latent(spark, sf_dir):
    """A file for each requested end: exact, only, next behind, or last one. Requests are repeated."""
    requests = read(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") % 50).alias("want"))
    files = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.floor("l_quantity").alias("file_end"))
    return align.resolve_ranges(requests, files, ["o_orderkey"], "want", "file_end", []).select("o_orderkey", "want", "file_end", "tier")


@query("select user_id, cast(ts as date) as day, count(distinct event_type) as children from events where event_type in ('view', 'click', 'error') group by all having count(distinct event_type) = 3")
def camera_complete(spark, sf_dir):
    """Days on which a user has every camera."""
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return align.complete_groups(e, ["user_id", "day"], "event_type", ["view", "click", "error"])


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def missing_work(spark, sf_dir):
    """Orders without an output yet."""
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")
