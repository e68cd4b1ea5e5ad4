"""Recordings made uniform: clocks, camera roles, action columns, layouts of model inputs, and draws by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indexing, mixing

#: What an action may be relative to.
REPRESENTATIONS = ("absolute", "delta")
#: Names of wrist cameras that hold a crop.
CROP = "right_in_"


def choose_time(df: DataFrame, by: Sequence[str], order: Sequence[str], clocks: Sequence[Column], fps: float, into: str = "time") -> DataFrame:
    """Seconds since an episode's first row: by the first clock that all its rows have, else evenly at ``fps``.

    Adds ``into`` and clock, the number of the clock taken (that of the even one comes after the last).
    """
    whole, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
    even = (F.row_number().over(w) - 1) / F.lit(float(fps))
    out = df
    for k, c in enumerate(clocks):
        out = out.withColumn(f"_c{k}", c)
    complete = [F.count(f"_c{k}").over(whole) == F.count(F.lit(1)).over(whole) for k in range(len(clocks))]
    number, value = F.lit(len(clocks)), even
    for k in reversed(range(len(clocks))):
        number, value = F.when(complete[k], k).otherwise(number), F.when(complete[k], F.col(f"_c{k}") - F.first(f"_c{k}").over(w)).otherwise(value)
    return out.withColumn("clock", number).withColumn(into, value).drop(*[f"_c{k}" for k in range(len(clocks))])


def first_complete(df: DataFrame, tiers: Sequence[Sequence[str]], by: Sequence[str], into: str = "action") -> DataFrame:
    """The columns of the first tier that an episode has throughout, as an array; tiers with unknown columns are left out.

    Adds ``into`` (null without any) and tier (its place in ``tiers``).
    """
    whole = Window.partitionBy(*by)
    number, value = F.lit(None).cast("int"), F.lit(None).cast("array<double>")
    for k, names in reversed(list(enumerate(tiers))):
        if all(n in df.columns for n in names):
            missing = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) if len(names) > 1 else F.col(names[0]).isNull().cast("int")
            has = F.max(missing).over(whole) == 0
            number, value = F.when(has, k).otherwise(number), F.when(has, F.array(*[F.col(n).cast("double") for n in names])).otherwise(value)
    return df.withColumn(into, value).withColumn("tier", number)


def camera_roles(cameras: DataFrame, by: Sequence[str], sides: Sequence[str] = ("left", "right")) -> DataFrame:
    """(by, role, camera): a side's wrist camera is its wrist; its plain camera is then its main one, else the wrist."""
    rows = cameras.groupBy(*by).agg(F.collect_set("camera").alias("_has"))
    has = lambda name: F.array_contains("_has", name)
    roles = []
    for side in sides:
        wrist = f"wrist_{side}"
        roles.append((f"{side}_wrist", F.when(has(wrist), wrist).when(has(side), side)))
        roles.append((f"{side}_main", F.when(has(wrist) & has(side), side)))
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), camera.alias("camera")) for role, camera in roles]))
    return rows.select(*by, each.alias("_r")).select(*by, "_r.role", "_r.camera").where("camera is not null")


def carried_camera(df: DataFrame, image: str, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """A camera without an image takes that of the one before it; the first ones take the first image there is."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(image, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col(image).isNotNull(), F.struct(*order, F.col(image).alias("_image")))).over(Window.partitionBy(*by))
    return df.withColumn(into, F.coalesce(before, first["_image"]))


def representation(name: Column) -> Column:
    """The representation's canonical name; an error for others."""
    plain = F.lower(F.trim(name))
    return F.when(plain.isin(*REPRESENTATIONS), plain).otherwise(F.raise_error(F.concat(F.lit("no action representation: "), F.coalesce(name, F.lit("null")))).cast("string"))


def same_representation(manifest: DataFrame, column: str) -> DataFrame:
    """One row with the representation that all rows of a manifest share; an error if they differ."""
    each = manifest.agg(F.collect_set(representation(F.col(column))).alias("_all"))
    return each.select(F.when(F.size("_all") <= 1, F.get("_all", F.lit(0))).otherwise(F.raise_error(F.lit("representations differ")).cast("string")).alias(column))


def concat_places(parts: DataFrame, by: Sequence[str], camera: str, main: str) -> DataFrame:
    """Where each camera's latent goes: (row, column). Crops make the first row, arms the next, the main camera the last.

    ``position`` orders the wrist cameras; rows without a camera are left out of the count.
    """
    kind = F.when(F.col(camera) == main, 2).when(F.contains(F.col(camera), F.lit(CROP)), 0).otherwise(1)
    rows = parts.withColumn("_kind", kind)
    place = F.row_number().over(Window.partitionBy(*by, "_kind").orderBy("position")) - 1
    row = F.dense_rank().over(Window.partitionBy(*by).orderBy("_kind")) - 1
    return rows.withColumn("row", row).withColumn("column", place).drop("_kind")


def folded_place(row: Column, channel: Column, frames: Column, per_frame: int) -> Column:
    """Flat place of value (row, channel) of ``frames * per_frame`` rows in the layout channel, frame, row of the frame."""
    frame, inside = F.floor(row / per_frame), row % per_frame
    return ((channel * frames + frame) * per_frame + inside).cast("long")


def draw_number(seed: Column, slot: Column, size: Column) -> Column:
    """A number below ``size``, the same for the same seed and slot on any engine: the start of an MD5 digest."""
    return F.pmod(mixing.drawn(seed, slot), size)


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return indexing.running(df, order, F.lit(1), "_number")


def rank_draws(df: DataFrame, order: Sequence[str], ranks: int, size: int, seed: int, stride: int = 100_003) -> DataFrame:
    """``size`` rows with replacement for each rank, whose seed is seed + rank * stride. Adds rank and slot."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    slots = df.sparkSession.range(ranks).withColumnRenamed("id", "rank").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    picked = slots.join(F.broadcast(n)).where("_n > 0").withColumn("_number", draw_number(F.lit(seed) + F.col("rank") * stride, F.col("slot"), F.col("_n")))  # one row
    return picked.drop("_n").join(_numbered(df, order), "_number").drop("_number")


def retried_draws(df: DataFrame, order: Sequence[str], valid: Column, size: int, seed: int, tries: int = 20) -> DataFrame:
    """One row for each slot: the first valid one of up to ``tries`` draws. Adds slot and attempt; hopeless slots have none."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    slots = df.sparkSession.range(size).withColumnRenamed("id", "slot").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    picked = slots.join(F.broadcast(n)).where("_n > 0").withColumn("_number", draw_number(F.lit(seed), F.col("slot") * tries + F.col("attempt"), F.col("_n")))  # one row
    good = picked.drop("_n").join(_numbered(df, order).where(valid), "_number").drop("_number")
    first = F.row_number().over(Window.partitionBy("slot").orderBy("attempt"))  # ``tries`` rows at most
    return good.withColumn("_r", first).where("_r = 1").drop("_r")


def by_dataset(batch: DataFrame, by: Sequence[str], dataset: str, position: str) -> DataFrame:
    """The positions of a mixed batch that belong to each dataset, in order."""
    return batch.groupBy(*by, dataset).agg(F.sort_array(F.collect_list(position)).alias("positions"))


def rank_reduce(df: DataFrame, by: Sequence[str], rank: str, value: str) -> DataFrame:
    """Mean and maximum over ranks of each rank's own mean."""
    own = df.groupBy(*by, rank).agg(F.avg(value).alias("_v"))
    return own.groupBy(*by).agg(F.avg("_v").alias("mean"), F.max("_v").alias("max"), F.count(F.lit(1)).alias("ranks"))
