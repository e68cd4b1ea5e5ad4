"""Rounds of training samples with a manifest.

Samples of a round are written below a folder of their own; then one manifest row names it, with the number of samples, the
configuration and the representation of actions. A round counts from the moment its row is there: writers that die leave
folders that nobody reads, and a round that is written again replaces the one before as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.records import REPRESENTATIONS, same_representation

from .pairs import validate_samples

MANIFEST = "round int, serial long, folder string, samples long, config string, action_representation string, history_action_representation string"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_samples(samples: DataFrame, root: str, round_id: int, config: str, representation: str = "delta") -> int:
    """Writes a round and returns its number of samples. ``samples`` has the chunks ``winner`` and ``loser``, which must have
    one shape, and any other columns. The count is taken while writing. One writer at a time for each round."""
    if representation not in REPRESENTATIONS:
        raise ValueError(f"representation must be one of {sorted(REPRESENTATIONS)}")
    spark, folder, seen = samples.sparkSession, uuid.uuid4().hex, Observation()
    validate_samples(samples).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/samples/folder={folder}")
    serial = 1
    if _exists(spark, f"{root}/manifest"):
        serial += _manifest(spark, root).where(F.col("round") == round_id).agg(F.coalesce(F.max("serial"), F.lit(0))).first()[0]
    row = (round_id, serial, folder, seen.get["n"], config, representation, "absolute")
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return seen.get["n"]


def rounds(spark: SparkSession, root: str) -> DataFrame:
    """The manifest rows that count: the newest of each round."""
    return _manifest(spark, root).groupBy("round").agg(F.max_by(F.struct("*"), "serial").alias("_r")).select("_r.*")


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """Samples of all finished rounds, with ``round`` and ``action_representation``; rounds of different representations are
    an error. Folders are partitions, so those that no round names are not read."""
    known = rounds(spark, root)
    shared = same_representation(known, "action_representation")
    named = F.broadcast(known.select("round", "folder"))  # one row for each round
    return spark.read.parquet(f"{root}/samples").join(named, "folder").drop("folder").crossJoin(F.broadcast(shared))
