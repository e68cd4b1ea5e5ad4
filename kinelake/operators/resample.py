"""Resampling onto uniform grids: clean series, grids, linear and spherical interpolation, nearest rows.

A grid and its samples are united and ordered by one window, so that each grid point sees the sample before and the
sample after it: one shuffle by series, whatever the rates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.operators import align


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def prepare_series(df: DataFrame, by: Sequence[str], time: str, position: str, values: Sequence[str]) -> DataFrame:
    """Samples with finite time and values; of equal times the one with the least position."""
    good = df
    for v in [time, *values]:
        good = good.where(finite(F.col(v)))
    return good.withColumn("_r", F.row_number().over(Window.partitionBy(*by, time).orderBy(position))).where("_r = 1").drop("_r")


def uniform_grid(windows: DataFrame, start: str, end: str, fps: float) -> DataFrame:
    """(frame_index, grid_time) at ``fps`` from start while it is at most end; windows of no length have none."""
    n = F.greatest(F.lit(1), F.floor((F.col(end) - F.col(start)) * fps) + 1)
    good = windows.where(F.col(end) > F.col(start))
    return good.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))).withColumn("grid_time", F.col(start) + F.col("frame_index") / F.lit(float(fps)))


def _bracket(grid: DataFrame, samples: DataFrame, by: Sequence[str], time: str, value: str, slices: int | None = 0) -> DataFrame:
    """Grid rows with _before and _after: structs (t, v) of the neighbouring samples; both are the sample at its own time.
    ``slices`` as in :func:`kinelake.operators.align.asof`."""
    row = F.struct(*[F.col(c) for c in grid.columns])
    s = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    s_type = samples.select(s.alias("s")).schema["s"].dataType
    a = grid.select(*by, F.col("grid_time").alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(s_type).alias("_s"))
    b = samples.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), s.alias("_s"))
    u, sliced = align.in_slices(a.unionByName(b), by, slices)
    # Each frame grows by one row at a time: what comes after is what came before, from the end.
    u = align.neighbour(u, by, "_s", "_before", "_s", False, sliced)
    u = align.neighbour(u, by, "_s", "_after", "_s", True, sliced)
    return u.where(F.col("_row").isNotNull()).select("_row.*", "_before", "_after")


def interpolate(grid: DataFrame, samples: DataFrame, by: Sequence[str], time: str, value: str, into: str, mix: Callable[[Column, Column, Column], Column] | None = None, slices: int | None = 0) -> DataFrame:
    """Values on the grid between neighbouring samples; the ends hold beyond the series. ``mix(a, b, u)`` is linear by default."""
    both = _bracket(grid, samples, by, time, value, slices)
    a, b = F.col("_before"), F.col("_after")
    mix = mix or (lambda x, y, u: x + (y - x) * u)
    u = (F.col("grid_time") - a["t"]) / (b["t"] - a["t"])
    out = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == b["t"]), a["v"]).otherwise(mix(a["v"], b["v"], u))
    return both.withColumn(into, out).drop("_before", "_after")


def interpolate_rotation(grid: DataFrame, samples: DataFrame, by: Sequence[str], time: str, value: str, into: str, slices: int | None = 0) -> DataFrame:
    """Quaternions on the grid along the shortest arcs."""
    return interpolate(grid, samples.withColumn(value, pose.quat_normalize(F.col(value), canonical=False)), by, time, value, into, pose.slerp, slices)


def nearest_index(grid: DataFrame, samples: DataFrame, by: Sequence[str], time: str, index: str, into: str, slices: int | None = 0) -> DataFrame:
    """The index of the sample nearest to each grid point; the earlier one wins a tie."""
    both = _bracket(grid, samples, by, time, index, slices)
    a, b, g = F.col("_before"), F.col("_after"), F.col("grid_time")
    first = a.isNotNull() & (b.isNull() | (g - a["t"] <= b["t"] - g))
    return both.withColumn(into, F.when(first, a["v"]).otherwise(b["v"])).drop("_before", "_after")


def rebase(df: DataFrame, time: str, by: Sequence[str], into: str) -> DataFrame:
    """Time since the group's first row."""
    return df.withColumn(into, F.col(time) - F.min(time).over(Window.partitionBy(*by)))


def bridge(start: Column, target: Column, arrival: Column, horizon: int, fraction: float = 0.5, max_step: float = 0.04, tangent: float = 1.0) -> Column:
    """``horizon`` commands that lead from ``start`` into the chunk ``target``: a cubic curve whose steps are capped, with
    turns along the arc and linear grippers, then the chunk itself. ``arrival`` is the command after the bridge."""
    n = max(1, min(horizon, round(horizon * fraction)))
    end = F.get(target, F.least(F.lit(n - 1), F.size(target) - 1))

    def position(off: int, u: Column, before: Column) -> Column:
        def axis(k: int) -> Column:
            p0, p3 = pose.at(start, off + k), pose.at(end, off + k)
            p1, p2 = (p0 + p3) * 0.5, p3 - (pose.at(arrival, off + k) - p3) * (tangent * n / 3)
            v = 1 - u
            return v * v * v * p0 + 3 * v * v * u * p1 + 3 * v * u * u * p2 + u * u * u * p3

        curve = F.array(*[axis(k) for k in range(3)])

        def capped(c: Column) -> Column:
            last = pose.part(before, off, 3)
            return pose.let(pose.distance(c, last), lambda d: F.when(d > max_step, F.zip_with(last, c, lambda x, y: x + (y - x) * (max_step / d))).otherwise(c))

        return pose.let(curve, capped)

    def step(before: Column, i: Column) -> Column:
        u = (i + 1) / F.lit(float(n))
        arm = lambda o: F.concat(position(o, u, before), pose.slerp(pose.part(start, o + 3, 4), pose.part(end, o + 3, 4), u), F.array((1 - u) * pose.at(start, o + 7) + u * pose.at(end, o + 7)))
        return F.concat(arm(pose.LEFT), arm(pose.RIGHT))

    empty = F.struct(F.array().cast("array<array<double>>").alias("done"), start.alias("last"))
    path = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), empty, lambda acc, i: pose.let(step(acc["last"], i), lambda s: F.struct(F.array_append(acc["done"], s).alias("done"), s.alias("last"))))
    rest = F.transform(F.sequence(F.lit(n), F.lit(max(n, horizon - 1))), lambda i: F.get(target, F.least(i, F.size(target) - 1)))
    return path["done"] if n >= horizon else F.concat(path["done"], rest)
