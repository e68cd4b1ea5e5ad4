"""Sample windows over episodes: clips, histories, look-ahead chunks, key frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import mixing
from .sequence import ordered


def raw_window(ratio: int, images: int = 9, actions: int = 32, stride: int = 4) -> int:
    """Frames that a clip spans at one frequency ratio."""
    return max((images - 1) * stride * ratio + 1, (actions - 1) * ratio + 1)


def clip_plan(segments: DataFrame, start: str, end: str, ratios: Sequence[int], **sizes: int) -> DataFrame:
    """Every clip start of every segment [start, end) at every ratio; segments that are too short have none."""
    images, actions, stride = sizes.get("images", 9), sizes.get("actions", 32), sizes.get("stride", 4)
    each = segments.withColumn("ratio", F.explode(F.array(*[F.lit(r).cast("long") for r in ratios])))
    each = each.withColumn("span", F.greatest((images - 1) * stride * F.col("ratio") + 1, (actions - 1) * F.col("ratio") + 1))
    each = each.where(F.col(end) - F.col(start) >= F.col("span"))
    return each.withColumn("clip_start", F.explode(F.sequence(F.col(start).cast("long"), F.col(end).cast("long") - F.col("span"))))


def clip_frames(clips: DataFrame, images: int = 9, actions: int = 32, stride: int = 4) -> DataFrame:
    """Adds image_frames and action_frames: the places that each clip reads."""
    grid = lambda n, step: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("clip_start") + i * step * F.col("ratio"))
    return clips.withColumn("image_frames", grid(images, stride)).withColumn("action_frames", grid(actions, 1))


def random_start(segments: DataFrame, start: str, end: str, span: int, key: Sequence[str], seed: int) -> DataFrame:
    """One clip start of each segment, uniform over all that fit (the last one included), by hash of the key."""
    fits = segments.where(F.col(end) - F.col(start) >= span)
    return fits.withColumn("clip_start", F.col(start) + F.pmod(mixing.drawn(seed, *key), F.col(end) - F.col(start) - span + 1))


def lookahead(df: DataFrame, col: str, horizon: int, by: Sequence[str], order: Sequence[str], into: str = "chunk") -> DataFrame:
    """The next ``horizon`` values from each row on; the last one repeats."""
    ahead = F.collect_list(col).over(ordered(by, order).rowsBetween(0, horizon - 1))
    padded = F.concat(F.col("_a"), F.array_repeat(F.element_at("_a", -1), F.lit(horizon) - F.size("_a")))
    return df.withColumn("_a", ahead).withColumn(into, padded).drop("_a")


def complete_chunks(df: DataFrame, horizon: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that have ``horizon`` rows from themselves on."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("_i", F.row_number().over(ordered(by, order))).withColumn("_n", n).where("_i <= _n - {} + 1".format(int(horizon))).drop("_i", "_n")


def strided_history(df: DataFrame, col: str, index: str, stride: int, length: int, by: Sequence[str], empty: Column, into: str = "history") -> DataFrame:
    """Up to ``length`` earlier values, ``stride`` rows apart and in phase with the row, padded in front; and their mask."""
    back = ordered(by, [index]).rowsBetween(-stride * length, -1)
    seen = F.collect_list(F.struct(F.col(index).alias("i"), F.col(col).alias("v"))).over(back)
    kept = F.transform(F.filter("_s", lambda s: (F.col(index) - s["i"]) % stride == 0), lambda s: s["v"])
    out = df.withColumn("_s", seen).withColumn("_k", kept)
    pad = F.lit(length) - F.size("_k")
    mask = F.concat(F.array_repeat(F.lit(False), pad), F.array_repeat(F.lit(True), F.size("_k")))
    return out.withColumn(into, F.concat(F.array_repeat(empty, pad), F.col("_k"))).withColumn(into + "_mask", mask).drop("_s", "_k")


def kept_history(kept: DataFrame, index: str, stride: int, length: int, by: Sequence[str], empty: Column, into: str = "history") -> DataFrame:
    """The same over kept rows alone, however far apart their indices are: ``stride`` counts kept rows."""
    numbered = kept.withColumn("_pos", F.row_number().over(ordered(by, [index])).cast("long") - 1)
    return strided_history(numbered, index, "_pos", stride, length, by, empty, into).drop("_pos")


def keyframes(frames: DataFrame, intervals: DataFrame, every: int, by: Sequence[str], index: str) -> DataFrame:
    """Frames to keep: all inside the intervals [start, end] (both included), every ``every``-th between them, counted
    anew after each interval, and the first and the last. Overlapping intervals count as one."""
    marks = frames.select(*by, F.col(index).alias("_i"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"))
    begins = intervals.select(*by, F.col("start").cast("long").alias("_i"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"))
    w = Window.partitionBy(*by).orderBy("_i", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(begins).withColumn("_to", F.max("_end").over(w)).where("_kind = 1")
    whole = Window.partitionBy(*by)
    n = seen.withColumn("_first", F.min("_i").over(whole)).withColumn("_last", F.max("_i").over(whole))
    inside = F.coalesce(F.col("_i") <= F.col("_to"), F.lit(False))
    gap = F.col("_i") - F.coalesce(F.col("_to") + 1, F.col("_first"))
    keep = inside | (gap % every == 0) | (F.col("_i") == F.col("_first")) | (F.col("_i") == F.col("_last"))
    return n.where(keep).select(*by, F.col("_i").alias(index), inside.alias("in_interval"))


def keyframe_windows(kept: DataFrame, by: Sequence[str], index: str, actions: int = 32, stride: int = 4) -> DataFrame:
    """Every run of actions + 1 kept frames: its action frames, its image frames, the frames it spans."""
    ahead = ordered(by, [index]).rowsBetween(0, actions)
    rows = kept.withColumn("_w", F.collect_list(index).over(ahead)).where(F.size("_w") == actions + 1)
    images = F.transform(F.sequence(F.lit(0), F.lit(actions), F.lit(stride)), lambda i: F.get("_w", i))
    out = rows.withColumn("action_frames", F.slice("_w", 1, actions)).withColumn("image_frames", images)
    span = F.element_at("image_frames", -1) - F.element_at("image_frames", 1) + 1
    return out.withColumn("span", span).withColumn("step", uniform_step(F.col("_w"))).drop("_w")


def uniform_step(v: Column) -> Column:
    """The positive step between all neighbours of an array; null if they differ or there is none."""
    steps = F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.get(v, i) - F.get(v, i - 1))
    return F.when((F.size(v) > 1) & (F.array_min(steps) == F.array_max(steps)) & (F.array_min(steps) > 0), F.array_min(steps))


def trim_count(n: Column, stride: int) -> Column:
    """How many of n frames an encoder that takes 1 + k * stride accepts."""
    return F.when(n > 0, F.floor((n - 1) / stride) * stride + 1).otherwise(0)


def fit_length(v: Column, n: int) -> Column:
    """The first n values; the last one repeats if there are fewer."""
    return F.when(F.size(v) >= n, F.slice(v, 1, n)).otherwise(F.concat(v, F.array_repeat(F.element_at(v, -1), F.lit(n) - F.size(v))))


def split_by_time(df: DataFrame, start: str, failed_at: str) -> DataFrame:
    """Adds side: loser for rows that start by the failure (it included), after for later ones."""
    return df.withColumn("side", F.when(F.col(start) <= F.col(failed_at), "loser").otherwise("after"))
