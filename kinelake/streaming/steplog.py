"""The step log: an idempotent sink for the steps of running episodes.

A micro-batch writes its own folder, replacing what an earlier attempt left there, and then its line in the commit table.
Readers see committed batches only, and only the attempt that the commit names, so a batch that is replayed after a fault
adds nothing and a batch that stopped half-way shows nothing. Aborted episodes are named in a table of their own: their
steps vanish for readers at once and from disk with :func:`vacuum`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One step of an episode: what was seen, proposed, corrected, sent and earned.
STEP = (
    "episode long, step long, timestamp double, state16 array<double>, prior_action16 array<double>, command_prior_action16 array<double>, "
    "prior_action16_chunk array<array<double>>, policy_residual_action14 array<double>, residual_action14 array<double>, fused_action16 array<double>, "
    "fused_action16_chunk array<array<double>>, executed_action16 array<double>, executed_action16_chunk array<array<double>>, command_action16 array<double>, "
    "command_action16_chunk array<array<double>>, intervened boolean, command_sent boolean, skipped_execution boolean, reward double, terminated boolean, "
    "truncated boolean, outcome string"
)
COMMITS = "batch long, attempt string, steps long"


def steps(df: DataFrame, fake: bool = False) -> DataFrame:
    """Rows of ``STEP``: missing fields are null, a step without a sent command was skipped unless the robot is ``fake``.

    Vectors of 16 or 14 channels that have another length are an error.
    """
    fields = [tuple(f.strip().split(" ", 1)) for f in STEP.split(", ")]
    sent = F.coalesce("command_sent", F.lit(True)) if "command_sent" in df.columns else F.lit(True)
    given = {name: F.col(name) if name in df.columns else F.lit(None) for name, _ in fields} | {"command_sent": sent, "skipped_execution": ~sent & F.lit(not fake)}
    out = df.select(*[given[name].cast(kind).alias(name) for name, kind in fields])
    for name, kind in fields:
        width = name[-2:]
        if kind == "array<double>" and width.isdigit():
            right = F.col(name).isNull() | (F.size(name) == int(width))
            out = out.withColumn(name, F.when(right, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} has {width} channels")).cast(kind)))
    return out


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """Publishes one micro-batch; a second call with the same number replaces the first by equal rows."""
    spark = batch.sparkSession
    done = _read(spark, f"{path}/commits", COMMITS)
    if done.where(F.col("batch") == number).take(1):
        return
    attempt = uuid.uuid4().hex
    batch.write.mode("overwrite").parquet(f"{path}/steps/batch={number}/attempt={attempt}")
    n = spark.read.schema(STEP).parquet(f"{path}/steps/batch={number}/attempt={attempt}").count()
    line = spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.lit(attempt).alias("attempt"), F.lit(n).cast("long").alias("steps"))
    line.write.mode("append").parquet(f"{path}/commits")


def append(df: DataFrame, path: str, checkpoint: str, fake: bool = False):
    """The writer of a stream of steps; start it with ``.start()``."""
    return steps(df, fake).writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path)).option("checkpointLocation", checkpoint)


def abort(episodes: DataFrame, path: str) -> None:
    """Withdraws episodes (episode), whatever has been written or will be."""
    episodes.select(F.col("episode").cast("long").alias("episode")).distinct().write.mode("append").parquet(f"{path}/aborted")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The steps of committed batches, without those of aborted episodes."""
    commits = _read(spark, f"{path}/commits", COMMITS).groupBy("batch").agg(F.min("attempt").alias("attempt"))
    rows = _read(spark, f"{path}/steps", f"{STEP}, batch long, attempt string")
    held = rows.join(commits, ["batch", "attempt"], "left_semi")  # a row for each batch
    return held.join(_read(spark, f"{path}/aborted", "episode long"), "episode", "left_anti").drop("batch", "attempt")


def vacuum(spark: SparkSession, path: str, into: str) -> None:
    """Writes what readers see as one log of a single batch."""
    write_batch(read(spark, path), 0, into)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows; none if it is not there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
