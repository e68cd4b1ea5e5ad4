"""Sampling and mixing: batch quotas, seeded draws, slot replacement, dropout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators import indexing

#: Shares of the sources of a batch: in the first round there is no history yet.
FIRST_ROUND = (("current", 0.8), ("sft", 0.2))
LATER_ROUNDS = (("current", 0.7), ("history", 0.15), ("sft", 0.15))


def quotas(df: DataFrame, batch: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """(columns of df, source, quota): whole numbers that add up to the batch size, largest remainders rounded up.

    Equal remainders go to the earlier source.
    """
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("source"), F.lit(s).alias("share")) for k, (n, s) in enumerate(shares)])
    each = df.withColumn("_s", F.explode(table))
    each = each.select(*df.columns, F.col("_s.k").alias("_k"), F.col("_s.source").alias("source"), (F.col(batch) * F.col("_s.share")).alias("_raw"))
    each = each.withColumn("_floor", F.floor("_raw"))
    w = Window.partitionBy(*df.columns)
    left = F.col(batch) - F.sum("_floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_raw") - F.col("_floor")), "_k"))
    return each.withColumn("_left", left).withColumn("_rank", rank).select(*df.columns, "source", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


#: Values of a draw: 32 bits.
DRAWS = 1 << 32


def drawn(seed: Column | int, *key: Column | str) -> Column:
    """A number below ``DRAWS`` for a seed and a key, the same on any engine: the first 8 digits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """A random dense numbering from 0: rows are dealt to ranges of their draw, as many as the rows need, numbered inside,
    and the ranges' sizes added up. No task sees more than its ranges."""
    buckets = min(indexing.MOST, max(indexing.FEWEST, -(-df.count() // indexing.STRETCH_ROWS)))
    h = df.withColumn("_h", drawn(seed, *key)).withColumn("_b", F.expr(f"_h * {buckets} div {DRAWS}"))
    sizes = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).drop("_n")
    inside = h.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key)) - 1)
    return inside.join(F.broadcast(sizes), "_b").withColumn("number", F.col("_o") + F.col("_r")).drop("_h", "_b", "_o", "_r")  # ``buckets`` rows


def draw(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``n`` rows with replacement: slots 0 .. n - 1 look rows up by number. An empty table is an error."""
    if n and not df.take(1):
        raise ValueError("a required source is empty")
    own = numbered(df, key, seed)
    size = own.agg(F.count(F.lit(1)).alias("_size"))
    slots = df.sparkSession.range(n).select(F.col("id").alias("slot")).join(F.broadcast(size))  # one row
    picked = slots.withColumn("number", F.pmod(drawn(seed, "slot"), F.col("_size")))
    return picked.drop("_size").join(own, "number").drop("number")


def mixed_batch(spark: SparkSession, sources: dict[str, DataFrame], size: int, shares: Sequence[tuple[str, float]], key: Sequence[str], seed: int) -> DataFrame:
    """One batch of ``size`` rows drawn with replacement by quota, shuffled; adds source and position."""
    counts = {r["source"]: r["quota"] for r in quotas(spark.range(1).select(F.lit(size).cast("long").alias("size")), "size", shares).collect()}
    out = None
    for k, (name, _) in enumerate(shares):
        if counts[name]:
            part = draw(sources[name], counts[name], key, seed + k).withColumn("source", F.lit(name))
            out = part if out is None else out.unionByName(part)
    order = Window.partitionBy(F.lit(0)).orderBy(drawn(seed, "source", "slot"), "source", "slot")  # one batch, of a fixed size
    return out.withColumn("position", F.row_number().over(order) - 1).drop("slot")


def replace_slots(batch: DataFrame, source: str, preferred: str = "current") -> DataFrame:
    """Marks which slots hold preference rows: those of the preferred source; the others keep supervised rows."""
    return batch.withColumn("is_preference", F.col(source) == preferred)


def dropout(df: DataFrame, col: str, share: float, key: Sequence[str], seed: int) -> DataFrame:
    """Nulls a value with probability ``share``, decided by the row's key."""
    u = drawn(seed, *key) / float(DRAWS)
    return df.withColumn(col, F.when(u >= share, F.col(col)))


def sample_without_replacement(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """``n`` distinct rows by seeded order (a top-k, no full sort)."""
    return df.orderBy(drawn(seed, *key), *key).limit(n)
