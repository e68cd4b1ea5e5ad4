"""Exact deduplication with a log-structured merge index of digests (native: DataFrame functions only).

Memtables are the input's partitions. Each flushes one run of level 0: its entries (digest, identifier, place) sorted by
digest, in a Parquet file with statistics and a bloom filter on the digest. The runs' filters, added up, say which hash
places more than one entry has. An entry whose place is its own has no copy in any run: it is settled without a merge.
Compaction merges what is left by levels, ``FANOUT`` runs of level 1 and then one of level 2, and keeps the chosen
identifier and the number of entries of each digest. A group that holds a third of all rows reaches a merge task as one
entry from each run. Lookups (:meth:`DigestIndex.probe`) push their digests down to the runs' order and filters.

Digests with more than one entry are hits: their texts are compared byte by byte, and where a digest joins different
texts the rows are grouped again by the texts themselves.

Defined results: a null text counts as empty; equal means identical after lower-casing A-Z only; rows with the same id
and equal texts are copies of each other, one of which stays; a null id ranks below every other and stays only where
its whole group has null ids; an empty table gives an empty result; further columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, Scratch, ascii_lower, bitmap_filter, join_groups, might_contain, repeated_filter

#: Runs of level 1.
FANOUT = 16
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _known(keep: str) -> Column:
    """Ranks a null identifier below every other."""
    return (F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()).alias("known")


class DigestIndex:
    """Sorted digest runs in a shared folder, and their compaction. ``keep`` is "max" or "min" of the identifiers."""

    def __init__(self, spark: SparkSession, keep: str = "max"):
        if keep not in ("max", "min"):
            raise ValueError("keep must be 'max' or 'min'")
        self.spark, self.keep = spark, keep
        self.scratch = Scratch(spark, "digest-index")
        self._flushed: list[DataFrame] = []
        self._filter: KeyFilter | None = None
        self._merged: DataFrame | None = None

    def flush(self, entries: DataFrame) -> None:
        """Writes (digest, id) entries: one sorted run with a filter for each memtable (partition)."""
        first = len(self._flushed)
        place = F.struct(F.lit(first).alias("flush"), F.monotonically_increasing_id().alias("row"))
        runs = entries.select("digest", "id", place.alias("place"), F.spark_partition_id().alias("run")).sortWithinPartitions("digest", "id")
        self._flushed.append(self.scratch.put(f"level0-{first}", runs, **BLOOM))
        self._filter = self._merged = None

    def runs(self) -> DataFrame:
        """(digest, id, place, run) of level 0; a place is one entry's own."""
        out = self._flushed[0]
        for run in self._flushed[1:]:
            out = out.unionByName(run)
        return out

    def marked(self) -> DataFrame:
        """Level 0 with ``_hit``: false where the filters say that no other entry has the digest."""
        if self._filter is None:
            made = repeated_filter(self.runs(), "digest")
            self._filter = KeyFilter(self.scratch.put("filter", made.slots), made.bits)
        return might_contain(self.runs(), "digest", self._filter)

    def _merge(self, entries: DataFrame, by: list[str], level: str) -> DataFrame:
        pick = F.max if self.keep == "max" else F.min
        merged = entries.groupBy(*by).agg(pick("kept").alias("kept"), F.sum("n").alias("n"))
        return self.scratch.put(level, merged.sortWithinPartitions("digest"), **BLOOM)

    def compact(self) -> DataFrame:
        """(digest, keep_id, keep_place, n) of every digest that the filters leave to a merge: of all that occur twice.

        Of equal identifiers one entry is kept; a null identifier loses against every other.
        """
        if self._merged is None:
            entries = self.marked().where("_hit").select(F.pmod("run", F.lit(FANOUT)).alias("run"), "digest", F.struct(_known(self.keep), "id", "place").alias("kept"), F.lit(1).cast("long").alias("n"))
            self._merged = self._merge(self._merge(entries, ["run", "digest"], "level1"), ["digest"], "level2")
        return self._merged.select("digest", F.col("kept.id").alias("keep_id"), F.col("kept.place").alias("keep_place"), "n")

    def hits(self) -> DataFrame:
        return self.compact().where("n > 1")

    def probe(self, digests: list) -> DataFrame:
        """Entries of a few digests; the runs' filters and statistics skip the row groups that lack them."""
        return self.runs().where(F.col("digest").isin(digests))


def _norm(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _entries(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    entries = docs.select(F.col(f"`{id_col}`").alias("id"), _norm(F.col(f"`{text_col}`")).alias("norm"))
    return entries.withColumn("digest", digest(F.col("norm")))


def _differing(index: DigestIndex, suspects: DataFrame) -> DataFrame:
    """(digest) of several texts among (digest, norm) of hits. The least and greatest text are the same exactly if all are;
    both are aggregated before the shuffle."""
    texts = suspects.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low != high")
    return index.scratch.put("differing", texts.select("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest: Callable[[Column], Column] = sha256_of) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row. See the module for defined results."""
    entries = _entries(docs, id_col, text_col, digest)
    index = DigestIndex(docs.sparkSession, keep)
    index.flush(entries.select("digest", "id"))
    hits = index.scratch.put("hits", index.hits())
    differing = _differing(index, might_contain(entries, "digest", bitmap_filter(hits, "digest")).where("_hit"))
    if digest is not sha256_of or differing.take(1):  # another digest, or one with several texts: the texts decide
        own = DigestIndex(docs.sparkSession, keep)
        own.flush(entries.select(F.struct("digest", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("more")).alias("digest"), "id"))
        index, hits, sha = own, own.scratch.put("hits", own.hits()), F.col("digest.sha")
    else:
        sha = F.lower(F.hex("digest"))
    met = join_groups(index.marked().where("_hit").drop("_hit"), hits, "digest", "n", how="left")
    alone = index.marked().where("not _hit").select("digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
    single = F.col("n").isNull()
    met = met.select("digest", "id", F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"), (single | (F.col("place") == F.col("keep_place"))).alias("kept"))
    out = alone.unionByName(met)
    known = F.col("id").isNotNull()  # a null id stays only where its whole group has none
    kept = F.col("kept") & (known | F.col("keep_id").isNull())
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), sha.alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are written once with their digests. Those that the filters settle pass straight through; only hits meet their
    group's row.
    """
    scratch = Scratch(docs.sparkSession, "exact-drop")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.select(row, sha256_of(_norm(F.col(f"`{text_col}`"))).alias("digest"))
    held = scratch.put("rows", held).withColumn("id", F.col(f"row.`{id_col}`"))
    index = DigestIndex(docs.sparkSession, keep)
    index.flush(held.select("digest", "id"))
    hits = index.scratch.put("hits", index.hits())
    marked = might_contain(held, "digest", bitmap_filter(hits, "digest"))
    texts = marked.where("_hit").select("digest", _norm(F.col(f"row.`{text_col}`")).alias("norm"))
    differing = _differing(index, texts)
    met = join_groups(marked.where("_hit").drop("_hit"), hits, "digest", "n", how="left")
    out = marked.where("not _hit").select("row").unionByName(met.where("n is null").select("row"))
    best = met.where("n is not null and id <=> keep_id")
    pick = F.max_by if keep == "max" else F.min_by
    if differing.take(1):  # keep one row of each text of such a digest
        again = met.where("n is not null").join(differing, "digest", "left_semi").withColumn("norm", _norm(F.col(f"row.`{text_col}`")))
        out = out.unionByName(again.groupBy("digest", "norm").agg(pick("row", F.struct(_known(keep), "id")).alias("row")).select("row"))
        best = best.join(differing, "digest", "left_anti")
    # Rows with the chosen id may be repeated; one of them stays.
    ties = index.marked().where("_hit").groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest").distinct()
    ties = index.scratch.put("ties", ties)
    if ties.take(1):
        tied = best.join(ties, "digest", "left_semi").groupBy("digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(tied.select("row"))
        best = best.join(ties, "digest", "left_anti")
    return out.unionByName(best.select("row")).select("row.*")
