"""Indexing: first-appearance ids, running offsets, dense renumbering, shards, chunks, natural order, text keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a stretch at least about, the fewest and the most stretches, and keys that are looked at for each bound.
STRETCH_ROWS, FEWEST, MOST, LOOKS = 1 << 20, 16, 4096, 8
#: Bounds that are compared one by one; beyond them every such bound is compared first.
FANOUT = 64


def in_order(rows: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Adds ``_b``: which of about ``ranges`` stretches of the order a row is in; by default as many as the rows need.

    Bounds come from a sample of at most ``MOST * LOOKS`` keys or so. They say how even the stretches are, never what the
    result is. Rows of one key stay together.
    """
    total = rows.count()
    ranges = min(MOST, max(FEWEST, -(-total // STRETCH_ROWS))) if ranges is None else ranges
    keys = rows.select(*order)
    share = min(1.0, ranges * LOOKS / max(1, total))
    some = sorted({tuple(r): r for r in (keys.sample(share, 7) if share < 1 else keys).collect()}.items(), key=lambda x: tuple((v is not None, v) for v in x[0]))
    step = max(1, len(some) // ranges)
    fields = [rows.schema[c].dataType for c in order]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(key, fields, order)]) for key, _ in some[step::step]]
    if not bounds:
        return rows.withColumn("_b", F.lit(0))
    here = F.struct(*order)
    below = lambda some: F.size(F.filter(some, lambda bound: bound <= here))
    if len(bounds) <= FANOUT:
        return rows.withColumn("_b", below(F.array(*bounds)))
    parts = [bounds[k : k + FANOUT] for k in range(0, len(bounds), FANOUT)]
    part = below(F.array(*[p[0] for p in parts[1:]]))
    return rows.withColumn("_b", part * FANOUT + below(F.get(F.array(*[F.array(*p) for p in parts]), part)))


def running(rows: DataFrame, order: Sequence[str], amount: Column, into: str) -> DataFrame:
    """The sum of ``amount`` over the rows before each row in the order: inside a stretch, and over the stretches before."""
    dealt = in_order(rows, order)
    totals = dealt.groupBy("_b").agg(F.sum(amount).alias("_t"))
    first = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_f"))  # one row for each stretch
    own = F.sum(amount).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - amount
    return dealt.withColumn("_o", own).join(F.broadcast(first), "_b").withColumn(into, (F.col("_f") + F.col("_o")).cast("long")).drop("_b", "_o", "_f")


def first_appearance_ids(df: DataFrame, key: str, order: Sequence[str], into: str) -> DataFrame:
    """(key, id): ids from 0 in the order in which keys first appear. The ranking runs over keys, not rows."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    flat = firsts.select(key, *[F.col(f"_first.{c}").alias(f"_first_{k}") for k, c in enumerate(order)])
    return running(flat, [f"_first_{k}" for k in range(len(order))], F.lit(1), into).select(key, into)


def global_index(df: DataFrame, group: str, local: Sequence[str], into: str = "index") -> DataFrame:
    """Running offset of the groups before a row's group plus its place in it: dense over all rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running(sizes, [group], F.col("_n"), "_offset").drop("_n")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*local)) - 1
    return df.withColumn("_place", place).join(offsets, group).withColumn(into, F.col("_offset") + F.col("_place")).drop("_place", "_offset")


def renumber(df: DataFrame, group: str, into: str) -> DataFrame:
    """Dense numbers from 0 of the groups that are left, in their order."""
    left = df.select(group).distinct()
    return df.join(running(left, [group], F.lit(1), into), group)


def shard_round_robin(df: DataFrame, family: Sequence[str], order: Sequence[str], shards: int, into: str = "shard") -> DataFrame:
    """Every n-th row of a family goes to the same shard."""
    i = F.row_number().over(Window.partitionBy(*family).orderBy(*order)) - 1
    return df.withColumn(into, i % shards)


def chunk_name(episode: Column, size: int = 1000) -> Column:
    return F.format_string("chunk-%03d", F.floor(episode / size))


def episode_name(episode: Column) -> Column:
    return F.format_string("episode_%06d", episode)


def natural_key(text: Column, width: int = 20) -> Column:
    """Sorts like the text, with runs of digits compared as numbers (of up to ``width`` digits)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def normal_text(text: Column) -> Column:
    """Trimmed, blanks joined."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_variants(df: DataFrame, text: str) -> DataFrame:
    """(text_key, normal_text, raw_text, num_links): the raw texts of each key, a row each, so that a key may have any number."""
    raw = df.groupBy(F.col(text).alias("raw_text")).agg(F.count(F.lit(1)).alias("num_links"))  # counted before they move
    normal = normal_text(F.col("raw_text"))
    return raw.select(F.sha1(normal.cast("binary")).alias("text_key"), normal.alias("normal_text"), "raw_text", "num_links")


def text_keys(df: DataFrame, text: str) -> DataFrame:
    """(text_key, raw_texts, num_links): one row for each normalised text."""
    rows = df.select(F.sha1(normal_text(F.col(text)).cast("binary")).alias("_key"), F.sha1(F.col(text).cast("binary")).alias("_raw"))
    raw = rows.groupBy("_key", "_raw").agg(F.count(F.lit(1)).alias("_n"))  # repeated texts meet as counts
    return raw.groupBy(F.col("_key").alias("text_key")).agg(F.count(F.lit(1)).alias("raw_texts"), F.sum("_n").alias("num_links"))


def concat_with_offsets(tables: Sequence[DataFrame], index: str) -> DataFrame:
    """One table after another, the index running on; adds dataset (its number)."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("dataset", F.lit(k))
        out = t if out is None else out.unionByName(t)
    sizes = out.groupBy("dataset").agg((F.max(index) + 1).alias("_n"))
    offset = sizes.withColumn("_offset", F.sum("_n").over(Window.orderBy("dataset")) - F.col("_n")).drop("_n")
    return out.join(F.broadcast(offset), "dataset").withColumn("global_" + index, F.col(index) + F.col("_offset")).drop("_offset")  # one row for each table


def ordered_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def match_allow_list(paths: DataFrame, path: str, wanted: DataFrame, entry: str) -> DataFrame:
    """Allow-list lines with their path: the whole path, else a path's end, else a base name that only one path has.

    Comments (#) and blank lines are skipped. Adds path and how (path, suffix, name, ambiguous or missing).
    """
    lines = wanted.select(F.trim(F.col(entry)).alias("entry")).where("entry != '' and not startswith(entry, '#')").distinct()
    own = paths.select(F.col(path).alias("p"), F.element_at(F.split(F.col(path), "/"), -1).alias("base")).distinct()
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("base")))
    keyed = lines.withColumn("base", F.element_at(F.split("entry", "/"), -1))
    met = keyed.join(own, "base", "left")
    tier = F.when(F.col("p") == F.col("entry"), 0).when(F.col("p").endswith(F.concat(F.lit("/"), F.col("entry"))) & F.col("entry").contains("/"), 1).when(F.col("entry") == F.col("base"), 2)
    best = met.withColumn("_tier", tier).groupBy("entry").agg(F.min(F.struct("_tier", "p")).alias("m"), F.max("_n").alias("_n"), F.min("_tier").alias("t"), F.min(F.when(F.col("_tier").isNotNull(), F.struct("_tier", "p"))).alias("hit"))
    how = F.when(F.col("hit").isNull(), "missing").when(F.col("t") == 0, "path").when(F.col("t") == 1, "suffix").when(F.col("_n") > 1, "ambiguous").otherwise("name")
    return best.select("entry", how.alias("how"), F.when(~how.isin("missing", "ambiguous"), F.col("hit.p")).alias("path"))
