"""Episode repositories: a folder of Parquet frames by chunk, JSON-lines metadata and per-episode statistics.

Layout: ``data/chunk=NNN/*.parquet`` (frames), ``meta/info`` (one JSON row), ``meta/tasks``, ``meta/episodes``,
``meta/episode_stats`` (JSON lines). Spark's commit protocol publishes each table whole or not at all; the info table is
written last, and a folder without it is no repository.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import text
from kinelake.operators import indexing

FRAMES = "episode_index long, frame_index long, `index` long, task_index long, timestamp float, state array<float>, action array<float>"
EPISODES = "episode_index long, length long, tasks array<string>, segments array<struct<start_frame:long,end_frame:long,action_text:string,skill:string>>"
CHUNK = 1000


def write_json_lines(df: DataFrame, path: str) -> None:
    """Compact JSON lines; fields that are null are left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) != ''")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def index_frames(frames: DataFrame) -> DataFrame:
    """Frames (episode, frame_index, task, timestamp, state, action) with dense episode, global and task numbers."""
    numbered = indexing.renumber(frames, "episode", "episode_index")
    numbered = indexing.global_index(numbered, "episode_index", ["frame_index"])
    tasks = indexing.first_appearance_ids(numbered, "task", ["index"], "task_index")
    return numbered.join(tasks, "task")


def episode_stats(frames: DataFrame) -> DataFrame:
    """min, max, mean, std and count of each action channel of each episode."""
    x = frames.select("episode_index", F.posexplode("action").alias("channel", "x"))
    return x.groupBy("episode_index", "channel").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def write_repo(frames: DataFrame, path: str, fps: float) -> None:
    """Writes frames (episode, frame_index, task, timestamp, state, action) as a repository."""
    spark, staged = frames.sparkSession, f"{path}/.staged"  # numbered once; a hidden folder is no table
    numbered = index_frames(frames)
    numbered.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(numbered.schema).parquet(staged)
    wide = rows.select("episode_index", "frame_index", "index", "task_index", F.col("timestamp").cast("float").alias("timestamp"), F.col("state").cast("array<float>").alias("state"), F.col("action").cast("array<float>").alias("action"))
    by_chunk = wide.withColumn("chunk", F.floor(F.col("episode_index") / CHUNK))
    by_chunk.repartition("chunk", "episode_index").sortWithinPartitions("episode_index", "frame_index").write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/data")
    write_json_lines(rows.select("task_index", "task").distinct(), f"{path}/meta/tasks")
    length = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.sort_array(F.collect_set("task")).alias("tasks"))
    segment = F.array(F.struct(F.lit(0).cast("long").alias("start_frame"), F.col("length").alias("end_frame"), F.get("tasks", F.lit(0)).alias("action_text"), F.lit("").alias("skill")))
    write_json_lines(length.withColumn("segments", segment), f"{path}/meta/episodes")
    write_json_lines(episode_stats(rows), f"{path}/meta/episode_stats")
    totals = rows.agg(F.countDistinct("episode_index").alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"), F.countDistinct(F.size("action")).alias("widths"))
    checked = totals.withColumn("ok", F.assert_true(F.col("widths") <= 1, F.lit("all actions of a repository have one width")))
    write_json_lines(checked.select("total_episodes", "total_frames", F.lit(float(fps)).alias("fps"), F.lit("1").alias("version")), f"{path}/meta/info")
    at = spark._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def find_repos(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(root): folders at or below the paths that hold a finished repository, each once, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(list(paths)).select("path")
    at = "/meta/info/part-[^/]*$"
    return files.where(F.col("path").rlike(at)).select(F.regexp_replace("path", at, "").alias("root")).distinct().orderBy("root")


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(FRAMES + ", chunk long").parquet(f"{root}/data")


def read_episodes(spark: SparkSession, root: str, split: str | None = None, tasks: Sequence[str] = (), start: int = 0, limit: int | None = None) -> DataFrame:
    """Episodes with an instruction, in order; ``split`` is "a:b" of episode numbers, ``tasks`` filters by words, ``start`` skips.

    The instruction is the first segment's text, else the first task, else the folder's name as a phrase. Filters run on
    the metadata, before any frame is read.
    """
    e = read_json_lines(spark, f"{root}/meta/episodes", EPISODES)
    if split:
        low, _, high = split.partition(":")
        e = e.where(F.col("episode_index") >= int(low or 0))
        e = e.where(F.col("episode_index") < int(high)) if high else e
    folder = text.words_of_name(F.lit(root.rstrip("/").rsplit("/", 1)[-1]))
    e = e.withColumn("instruction", text.first_text(F.get("segments", F.lit(0))["action_text"], F.get("tasks", F.lit(0)), folder))
    e = e.where(text.matches_any(F.col("instruction"), tasks))
    if start:
        e = indexing.running(e, ["episode_index"], F.lit(1), "_r").where(F.col("_r") >= start).drop("_r")
    e = e.orderBy("episode_index")
    return e.limit(limit) if limit is not None else e


def segments(episodes: DataFrame) -> DataFrame:
    """One row for each valid segment; an episode without one is a single segment of its whole length."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start_frame"), F.col("length").alias("end_frame"), F.col("instruction").alias("action_text"), F.lit("").alias("skill")))
    valid = F.filter(F.coalesce("segments", F.array().cast("array<struct<start_frame:long,end_frame:long,action_text:string,skill:string>>")), lambda s: s["end_frame"] > s["start_frame"])
    return episodes.withColumn("_s", F.explode(F.when(F.size(valid) > 0, valid).otherwise(whole))).select("episode_index", "length", "instruction", "_s.*")


def eligible(seg: DataFrame, window: int, cameras: DataFrame | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Segments long enough for a window, of episodes that have every required camera; cut to the shortest camera."""
    out = seg
    if cameras is not None:
        c = cameras.where(F.col("camera").isin(list(required))).groupBy("episode_index").agg(F.countDistinct("camera").alias("_n"), F.min("frames").alias("_frames"))
        out = out.join(c.where(F.col("_n") == len(set(required))), "episode_index").withColumn("end_frame", F.least("end_frame", "length", "_frames")).drop("_n", "_frames")
    return out.where(F.col("end_frame") - F.col("start_frame") >= window)


def cache_key(ratio, episode, camera, clip_start):
    """The path of a cached clip; aliases of a camera share it."""
    name = F.when(camera == "cam_high", "cam_main").otherwise(camera)
    return F.concat_ws("/", F.concat(F.lit("ratio_"), ratio.cast("string")), indexing.chunk_name(episode), name, indexing.episode_name(episode), F.format_string("%06d", clip_start))


def missing_clips(jobs: DataFrame, cached: DataFrame) -> DataFrame:
    """Clip jobs (ratio, episode_index, camera, clip_start) that the cache (path) lacks."""
    keyed = jobs.withColumn("path", cache_key(F.col("ratio"), F.col("episode_index"), F.col("camera"), F.col("clip_start")))
    return keyed.join(cached.select("path").distinct(), "path", "left_anti")


def read_through(jobs: DataFrame, cached: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(hits and fresh values, fresh ones to append): cached rows are used, missing ones computed once."""
    keyed = jobs.withColumn("path", cache_key(F.col("ratio"), F.col("episode_index"), F.col("camera"), F.col("clip_start")))
    fresh = compute(keyed.join(cached.select("path"), "path", "left_anti"))
    return keyed.select("path").join(cached, "path").unionByName(fresh.select(*cached.columns)), fresh


def append_stages(stages: DataFrame, path: str) -> None:
    """Audit rows of finished stages (stage, round, command, outputs, status)."""
    stages.select("stage", "round", F.current_timestamp().alias("time"), "command", F.col("outputs").cast("array<string>").alias("outputs"), "status").write.mode("append").parquet(path)


def append_manifest(spark: SparkSession, path: str, stage: str, round_id: int, command: str, outputs: Sequence[str], status: str = "ok") -> None:
    """One audit row of a finished stage."""
    row = spark.range(1).select(F.lit(stage).alias("stage"), F.lit(round_id).alias("round"), F.lit(command).alias("command"), F.array(*map(F.lit, outputs)).alias("outputs"), F.lit(status).alias("status"))
    append_stages(row, path)


def stale_checkpoints(listing: DataFrame, keep: int = 2) -> DataFrame:
    """Checkpoints (path, modified) that go before a new one is written: all but the newest ``keep``."""
    newest = listing.orderBy(F.desc("modified"), F.desc("path")).limit(keep).select("path")
    return listing.join(F.broadcast(newest), "path", "left_anti")  # ``keep`` rows


def preflight(checks: DataFrame) -> DataFrame:
    """One row: whether every check (name, ok, detail) holds, and the names of those that fail."""
    return checks.agg(F.every("ok").alias("ok"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"))
