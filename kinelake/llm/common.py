"""Helpers that the training-data operators share: scratch tables, bounded bitmap filters, hot-key joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one bitmap of bitmap_construct_agg, and of a whole filter.
BITMAP_BITS, MOST_BITS = 32768, 1 << 26
#: Rows of one key that are no burden to the task that gets them.
FEW = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kinelake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Written tables of one operator run. Lineage ends at each of them, so a lost executor costs one stage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        path = self.path(name)
        writer = df.write.mode("overwrite")
        for key, value in options.items():
            writer = writer.option(key, value)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later stage reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


#: Characters that lower() may change beside A-Z.
OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{M}&&[^A-Z]]"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does that, and faster, where the text has no other cased character."""
    return F.when(col.rlike(OTHER_CASE), F.translate(col, UPPER, LOWER)).otherwise(F.lower(col))


@dataclass(frozen=True)
class KeyFilter:
    """Which hash places keys have: one row (slot, bitmap) for each used 4 KB slice of ``bits`` bits."""

    slots: DataFrame
    bits: int


def bits_for(keys: int) -> int:
    """A power of two, 16 for each key, at most ``MOST_BITS`` (8 MB): the bound on a filter's size, whatever the input."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << (16 * keys).bit_length()))


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(bits))


def bitmap_filter(keys: DataFrame, key: str, bits: int | None = None) -> KeyFilter:
    """The filter of ``keys``, a written table unless ``bits`` is given. It is small enough to broadcast; beyond the keys
    that it is made for it passes more rows, never fewer."""
    bits = bits or bits_for(keys.count())
    return KeyFilter(_slots(keys.select(_place(key, bits).alias("w"))), bits)


def repeated_filter(keys: DataFrame, key: str) -> KeyFilter:
    """A filter like that of ``bitmap_filter``, of the places that more than one row has."""
    bits = bits_for(keys.count())
    return KeyFilter(_slots(keys.groupBy(_place(key, bits).alias("w")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")), bits)


def _slots(places: DataFrame) -> DataFrame:
    return (
        places.select(F.expr(f"w div {BITMAP_BITS}").alias("slot"), F.expr(f"w % {BITMAP_BITS}").alias("bit"))
        .groupBy("slot")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def might_contain(df: DataFrame, key: str, kept: KeyFilter, flag: str = "_hit") -> DataFrame:
    """Adds ``flag``: false only where the key is surely not in the filter."""
    byte = "cast(conv(hex(substring(bitmap, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return (
        df.withColumn("_w", _place(key, kept.bits))
        .withColumn("_slot", F.expr(f"_w div {BITMAP_BITS}"))
        .withColumn("_bit", F.expr(f"cast(_w % {BITMAP_BITS} as int)"))
        .join(F.broadcast(kept.slots.withColumnRenamed("slot", "_slot")), "_slot", "left")
        .withColumn(flag, F.expr(f"coalesce(shiftright({byte}, _bit % 8) & 1, 0) = 1"))
        .drop("_w", "_slot", "_bit", "bitmap")
    )


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, share: int = 1000, how: str = "left") -> DataFrame:
    """Joins rows to the one row that ``groups`` has for each key, whatever the size of a group.

    A key that holds at least 1/``share`` of the rows, and ``FEW`` at least, is hot. There are at most ``share`` of them,
    which bounds their broadcast; the other keys, none of them hot, meet in a shuffle. ``count`` is the column of
    ``groups``, a written table, with the number of rows of the key.
    """
    total, most = groups.agg(F.sum(count), F.max(count)).first()
    least = max(FEW, -(-(total or 0) // share))
    if (most or 0) < least:
        return rows.join(groups, key, how)
    hot, cold = groups.where(F.col(count) >= least), groups.where(F.col(count) < least)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(cold, key, how)
    return marked.where("_hot").drop("_hot").unionByName(rest)
