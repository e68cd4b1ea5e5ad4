"""Time alignment: causal, nearest and forward as-of joins, n-way synchronisation, common windows.

Every operator orders by (time, tie-breaker), so results do not depend on how rows were partitioned. The joins are a
union and one window over the key: one shuffle, no range join, and no row is compared with more than its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators import indexing


def neighbour(u: DataFrame, by: Sequence[str], value: str, into: str, tie: str, forward: bool = False, sliced: bool = False) -> DataFrame:
    """Adds the last ``value`` that is not null at or before each row of (_t, _side, ``tie``), or the first at or after it.

    ``sliced`` rows have ``_b``, a slice of the order of (by, _t) (:func:`in_slices`): slices are tasks of their own, and
    what each leaves behind is carried to those after it, so one key's series is shared by all tasks.
    """
    order = [F.desc_nulls_first("_t"), F.col("_side"), F.desc(tie)] if forward else [F.col("_t"), F.col("_side"), F.col(tie)]
    keys = [*by, "_b"] if sliced else list(by)
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not sliced:
        return u.withColumn(into, F.last(value, ignorenulls=True).over(own))
    rank = F.when(F.col(value).isNotNull(), F.struct("_t", tie))
    left = u.groupBy(*keys).agg((F.min_by if forward else F.max_by)(value, rank).alias("_left"))  # a row for each slice of a key
    before = Window.partitionBy(*by).orderBy(F.desc("_b") if forward else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = left.withColumn(into, F.last("_left", ignorenulls=True).over(before)).where(F.col(into).isNotNull())
    given = {c: F.col(c) for c in (*keys, into)} | {"_side": F.lit(-1)}  # first of its slice: it has no time
    rows = carried.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in u.schema], into)
    met = u.withColumn(into, F.col(value)).unionByName(rows)
    return met.withColumn(into, F.last(into, ignorenulls=True).over(own)).where("_side >= 0")


def in_slices(u: DataFrame, by: Sequence[str], slices: int | None) -> tuple[DataFrame, bool]:
    """Rows with their slice of the order of (by, _t), and whether they have one. ``slices`` None: as many as the rows need; 0: none."""
    return (u, False) if slices == 0 else (indexing.in_order(u, [*by, "_t"], slices), True)


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, tie: str, values: Sequence[str], direction: str = "backward", prefix: str = "r_", slices: int | None = 0) -> DataFrame:
    """Each left row with the newest right row at or before it ("backward") or the first at or after it ("forward").

    Equal stamps match; among right rows with one stamp the last (backward) or first (forward) by ``tie`` wins. Rows
    without a match keep nulls. Adds prefix + time and prefix + value columns. A key is one task's work unless ``slices``
    says into how many slices of time the rows go (None: by their number), for series that one task cannot hold.
    """
    u, sliced = in_slices(_united(left, right, by, time, tie, values), by, slices)
    out = neighbour(u, by, "_r", "_m", "_tie", direction != "backward", sliced).where("_side = 1")
    return out.select("_row.*", F.col("_m.t").alias(prefix + time), *[F.col(f"_m.{v}").alias(prefix + v) for v in values])


def _united(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Left rows (_side 1, in _row) and right rows (_side 0, in _r) in one table."""
    held = F.struct(F.col(time).alias("t"), *[F.col(v) for v in values])
    mine = F.struct(*[F.col(c) for c in left.columns])
    stamp = F.when(F.col(time).isNotNull(), F.col(time)).alias("_t")  # not a plain alias: the optimiser fails on slices of one
    a = left.select(*by, stamp, F.col(tie).alias("_tie"), F.lit(1).alias("_side"), mine.alias("_row"), F.lit(None).cast(right.select(held.alias("s")).schema["s"].dataType).alias("_r"))
    b = right.select(*by, stamp, F.col(tie).alias("_tie"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_r"))
    return a.unionByName(b)


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, tie: str, values: Sequence[str], prefix: str = "r_", slices: int | None = 0) -> DataFrame:
    """Each left row with the right row nearest in time; the earlier one wins a tie. Both neighbours come from one shuffle."""
    u, sliced = in_slices(_united(left, right, by, time, tie, values), by, slices)
    both = neighbour(neighbour(u, by, "_r", "_before", "_tie", False, sliced), by, "_r", "_after", "_tie", True, sliced).where("_side = 1")
    gap = lambda c: F.abs(seconds(F.col(c)) - seconds(F.col("_t")))
    earlier = F.col("_before").isNotNull() & (F.col("_after").isNull() | (gap("_before.t") <= gap("_after.t")))
    pick = lambda v: F.when(earlier, F.col(f"_before.{v}")).otherwise(F.col(f"_after.{v}"))
    return both.select("_row.*", pick("t").alias(prefix + time), *[pick(v).alias(prefix + v) for v in values])


def seconds(t: Column) -> Column:
    """Epoch seconds as double, to the microsecond."""
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def nway_sync(streams: Sequence[tuple[str, DataFrame]], by: Sequence[str], time: str, tie: str, slop: float, slices: int | None = 0) -> DataFrame:
    """Rows of the first stream with the nearest row of every other one, where all stamps lie within ``slop`` seconds.

    Gives the first stream's rows with (name)_time and (name)_tie of the others, stamp (the newest) and skew (seconds).
    """
    _, out = streams[0]
    times = [time]
    for name, other in streams[1:]:
        found = asof_nearest(out, other.select(*by, time, tie), by, time, tie, [tie], "_n_", slices)
        out = found.withColumnsRenamed({"_n_" + time: f"{name}_time", "_n_" + tie: f"{name}_tie"})
        times.append(f"{name}_time")
    out = out.dropna(subset=times[1:])
    stamps = [F.col(t) for t in times]
    newest, oldest = (F.greatest(*stamps), F.least(*stamps)) if len(stamps) > 1 else (stamps[0], stamps[0])
    out = out.withColumn("stamp", newest).withColumn("skew", seconds(newest) - seconds(oldest))
    return out.where(F.col("skew") <= slop)


def common_window(df: DataFrame, by: Sequence[str], series: str, time: str, required: int) -> DataFrame:
    """The time that all of ``required`` series cover: latest first stamp to earliest last stamp; valid if not empty."""
    each = df.groupBy(*by, series).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    out = each.groupBy(*by).agg(F.max("first").alias("starts_at"), F.min("last").alias("ends_at"), F.count(F.lit(1)).alias("series"))
    return out.withColumn("valid", (F.col("series") == required) & (F.col("ends_at") > F.col("starts_at")))


def resolve_ranges(requests: DataFrame, files: DataFrame, by: Sequence[str], end: str, file_end: str, keep: Sequence[str]) -> DataFrame:
    """Each request with one file of its key: the one with its exact end, else the only one, else the one with the
    smallest end behind it, else the one with the largest end. Requests without a file keep nulls."""
    asked = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("_asked"))  # repeated requests meet as counts
    few = files.withColumn("_files", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    joined = asked.join(few, list(by), "left")
    e, want = F.col(file_end), F.col(end)
    tier = F.when(e == want, 0).when(F.col("_files") == 1, 1).when(e > want, 2).otherwise(3)
    near = F.when(e >= want, e).otherwise(-e)
    rank = F.struct(tier.alias("tier"), near.alias("near"), *[F.col(k) for k in keep])
    best = joined.groupBy(*requests.columns, "_asked").agg(F.min(F.when(e.isNotNull(), rank)).alias("_m"))
    each = best.withColumn("_copy", F.explode(F.expr("sequence(1L, _asked)")))
    return each.select(*requests.columns, *[F.col(f"_m.{k}").alias(k) for k in keep], F.abs("_m.near").alias(file_end), F.col("_m.tier").alias("tier"))


def complete_groups(df: DataFrame, by: Sequence[str], child: str, required: Sequence[str]) -> DataFrame:
    """Keys that have every required child."""
    return df.where(F.col(child).isin(list(required))).groupBy(*by).agg(F.countDistinct(child).alias("children")).where(F.col("children") == len(set(required)))
