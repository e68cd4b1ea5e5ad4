"""Streams over the tables: a replayed live source, silence by timers, the step log. Each runs its stream to the end."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators import indexing
from kinelake.streaming import live, silence, steplog

from .bindings import TRAJ, read, rounded, trajectory
from .source_queries import workspace

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


#: Messages of a topic that one segment holds, and that one micro-batch takes, at least; the most of a segment, which one
#: task writes and reads; and about how many segments and micro-batches a topic has. Tasks share a micro-batch by segments.
SEGMENT, BATCH, LONGEST, SEGMENTS, BATCHES = 400, 1000, 20_000, 64, 4


def sizes(most: int) -> tuple[int, int]:
    """Messages of a segment and of a micro-batch where the largest topic has ``most``: the number of micro-batches, each of
    which costs seconds whatever it takes, does not grow with the messages."""
    return min(LONGEST, max(SEGMENT, -(-most // SEGMENTS))), max(BATCH, -(-most // BATCHES))


def spooled(spark: SparkSession, rows: DataFrame, segment: int = SEGMENT) -> str:
    """A spool of (topic, seq, stamp, payload) rows, written by executors: a segment for each ``segment`` numbers of a topic."""
    return spools(spark, rows, segment, lambda s: 0, 1)[0]


def spools(spark: SparkSession, rows: DataFrame, segment: int, spool: Callable[[int], int], n: int) -> list[str]:
    """``n`` spools of rows that are computed once: ``spool`` says in which of them a topic's segment of a number is."""
    paths = [workspace(spark) for _ in range(n)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        path = paths[spool(int(part["seq"].iloc[0]) // segment)]
        return pd.DataFrame({"n": [live.publish(path, part["topic"].iloc[0], zip(part["seq"], part["stamp"], part["payload"]), segment)]})

    rows.groupBy("topic", F.expr(f"seq div {segment}").alias("s")).applyInPandas(run, "n long").agg(F.sum("n")).collect()
    return paths


def messages(spark: SparkSession, sf_dir: str, topic) -> DataFrame:
    """Events as messages: numbered by time in each topic, by stretches of all topics' order, so that no task holds a topic."""
    e = read(spark, sf_dir, "events").withColumn("topic", topic)
    payload = F.to_json(F.struct("event_id", "user_id", "event_type"))
    numbered = indexing.running(e, ["topic", "ts", "event_id"], F.lit(1), "_n")
    first = e.groupBy("topic").agg(F.count(F.lit(1)).alias("_c")).withColumn("_first", F.sum("_c").over(Window.orderBy("topic")) - F.col("_c"))  # a row for each topic
    stamp = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return numbered.join(F.broadcast(first), "topic").select("topic", (F.col("_n") - F.col("_first")).alias("seq"), stamp.alias("stamp"), payload.alias("payload"))


def largest(spark: SparkSession, sf_dir: str, topic) -> int:
    """Messages of the largest topic."""
    return read(spark, sf_dir, "events").groupBy(topic).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def streamed(spark: SparkSession, path: str, batch: int = BATCH) -> DataFrame:
    live.register(spark)
    return spark.readStream.format("live").option("maxRows", batch).load(path)


def run(spark: SparkSession, writer) -> None:
    """Starts a stream, lets it take what there is, and stops it. Timers need the RocksDB state store."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = writer.start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.set(name, before)


@query("""with n as (select event_type as topic, event_id, epoch_us(ts) as us, row_number() over (partition by event_type order by ts, event_id) - 1 as seq from events)
    select topic, seq, us, event_id from n""")
def live_messages(spark, sf_dir):
    """Topics read as a stream in two runs from one checkpoint: half of the messages come after the first run has stopped."""
    segment, batch = sizes(largest(spark, sf_dir, F.col("event_type")))
    path, later = spools(spark, messages(spark, sf_dir, F.col("event_type")), segment, lambda s: int(s >= 2 and s % 2), 2)
    out = workspace(spark)
    writer = lambda: streamed(spark, path, batch).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
    run(spark, writer())
    live_copy(spark, later, path)
    run(spark, writer())
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select("topic", "seq", F.unix_micros("stamp").alias("us"), F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


def live_copy(spark: SparkSession, source: str, into: str) -> None:
    """Moves published segments into another spool, as a recorder that comes back would publish them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    files = at.getFileSystem(conf)
    for topic, held in live.segments(source).items():
        for _, _, name in held:
            files.rename(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(f"{into}/{topic}/{name.rsplit('/', 1)[-1]}"))


@query("""with e as (select user_id, (epoch_us(ts) // 1000)::bigint as ms, ts, event_id from events), m as (select max(ms) as clock from e),
    g as (select distinct user_id, ms from e), n as (select user_id, ms, lead(ms) over (partition by user_id order by ms) as after from g)
    select user_id, ms as last_ms, ms + 7200000 as due_ms from n, m where coalesce(after > ms + 7200000, ms + 7200000 <= clock)""")
def silence_alarms(spark, sf_dir):
    """Users that say nothing for two hours, reported by timers as the watermark passes, also without a further row."""
    segment, batch = sizes(largest(spark, sf_dir, F.lit("all")))
    path, out = spooled(spark, messages(spark, sf_dir, F.lit("all")), segment), workspace(spark)
    rows = streamed(spark, path, batch).select(F.get_json_object("payload", "$.user_id").cast("long").alias("user_id"), "stamp")
    found = silence.over_stream(rows, "user_id", "stamp", 7200.0, "0 seconds")
    run(spark, found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append"))
    return spark.read.parquet(f"{out}/rows").select("user_id", F.unix_millis("last_seen").alias("last_ms"), F.unix_millis("due").alias("due_ms"))


@query(f"""with {TRAJ} select episode, frame_index as step, frame_index % 4 <> 1 as command_sent, frame_index % 4 = 1 as skipped_execution, case when frame_index = 0 then 'success' end as outcome, round(list_sum(action), 4) + 0.0 as a from traj where episode % 5 <> 3""")
def step_log(spark, sf_dir):
    """Steps of all episodes logged from a stream; every fifth episode is aborted, and a batch is delivered once more after a fault."""
    t = trajectory(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("episode").orderBy("frame_index")).cast("long") - 1)
    said = F.to_json(F.struct("episode", F.col("frame_index").alias("step"), F.col("action").alias("executed_action16"), (F.col("frame_index") % 4 != 1).alias("command_sent")))
    path, log = spooled(spark, t.select(F.concat(F.lit("robot-"), "episode").alias("topic"), "seq", F.col("seq").cast("double").alias("stamp"), said.alias("payload"))), workspace(spark)
    rows = streamed(spark, path).select(F.from_json("payload", "episode long, step long, executed_action16 array<double>, command_sent boolean").alias("r"), "stamp").select("r.*", F.unix_seconds("stamp").cast("double").alias("timestamp"))
    rows = rows.withColumn("outcome", F.when(F.col("step") == 0, "success"))
    run(spark, steplog.append(rows, log, f"{log}/checkpoint"))
    again = spark.read.schema(f"{steplog.STEP}, batch long, attempt string").parquet(f"{log}/steps").where("batch = 0").drop("batch", "attempt")
    steplog.write_batch(again, 0, log)
    steplog.abort(t.where("episode % 5 = 3").select("episode"), log)
    done = steplog.read(spark, log)
    return done.select("episode", "step", "command_sent", "skipped_execution", "outcome", rounded(F.aggregate("executed_action16", F.lit(0.0), lambda s, x: s + x), 4).alias("a"))
