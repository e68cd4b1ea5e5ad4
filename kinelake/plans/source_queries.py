"""Storage queries: round trips through the written formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.functions import layout
from kinelake.sources import codecs, repos, shared

from .bindings import TRAJ, read, rounded, trajectory

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def workspace(spark) -> str:
    """A folder of the shared scratch space."""
    return f"{shared.folder(spark)}/{uuid.uuid4().hex}"


@query(f"with {TRAJ} select episode as episode_index, frame_index, (row_number() over (order by episode, frame_index) - 1)::bigint as index, dense_rank() over (order by episode % 3) - 1 as task_index, round(action[1]::float::double, 6) + 0.0 as x from traj")
def repo_round_trip(spark, sf_dir):
    """Trajectories written as a repository and read again. Tasks first appear in the order of their numbers."""
    t = trajectory(spark, sf_dir)
    frames = t.withColumn("task", F.concat(F.lit("task "), (F.col("episode") % 3).cast("string"))).withColumn("timestamp", F.col("frame_index") / 10.0)
    path = workspace(spark)
    repos.write_repo(frames, path, 10.0)
    return repos.read_frames(spark, path).select("episode_index", "frame_index", "index", "task_index", rounded(F.get("action", F.lit(0)).cast("double")).alias("x"))


@query(f"with {TRAJ} select episode as episode_index, count(*) as length, 'task ' || (episode % 3) as instruction, 0::bigint as start_frame, count(*) as end_frame from traj group by episode having episode between 2 and 6")
def episode_reader(spark, sf_dir):
    """Episodes 2 to 6 of a repository with their instruction and segments."""
    t = trajectory(spark, sf_dir)
    frames = t.withColumn("task", F.concat(F.lit("task "), (F.col("episode") % 3).cast("string"))).withColumn("timestamp", F.col("frame_index") / 10.0)
    path = workspace(spark)
    repos.write_repo(frames, path, 10.0)
    return repos.segments(repos.read_episodes(spark, path, split="2:7", tasks=["TASK"])).select("episode_index", "length", "instruction", "start_frame", "end_frame")


@query("""with j as (select user_id as episode_index, event_id as clip_start, event_type as camera from events), k as (select *, 'ratio_1/' || printf('chunk-%03d', episode_index // 1000) || '/' || camera || '/' || printf('episode_%06d', episode_index) || '/' || printf('%06d', clip_start) as path from j)
    select path from k where clip_start % 3 <> 0""")
def cache_misses(spark, sf_dir):
    """Clips that a cache lacks."""
    jobs = read(spark, sf_dir, "events").select(F.lit(1).alias("ratio"), F.col("user_id").alias("episode_index"), F.col("event_type").alias("camera"), F.col("event_id").alias("clip_start"))
    key = repos.cache_key(F.col("ratio"), F.col("episode_index"), F.col("camera"), F.col("clip_start"))
    cached = jobs.where("clip_start % 3 = 0").select(key.alias("path"))
    return repos.missing_clips(jobs, cached).select("path")


@query("""with p as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as position from conversations) select conv_id, position::int as position, sha1(text) as part from p""")
def blob_split(spark, sf_dir):
    """Turns joined into one blob with their sizes, and taken apart."""
    c = read(spark, sf_dir, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    blob = whole.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "").cast("binary").alias("blob"), F.transform("t", lambda x: F.octet_length(x["text"]).cast("long")).alias("sizes"))
    return codecs.split_blob(blob, "blob", "sizes", ["conv_id"]).select("conv_id", "position", F.sha1("data").alias("part"))


@query("select page_id, case when contains(url, '::') then 'container' when regexp_matches(url, '(?i)\\.(mp4|avi|mov|mkv)$') then 'video' when regexp_matches(url, '(?i)\\.(h5|hdf5)$') then 'sidecar' else 'folder' end as kind, round(500 * 224.0::double / (page_id + 1), 6) as fx from pages")
def source_probe(spark, sf_dir):
    """Kinds of sources, and intrinsics after a resize."""
    k = layout.scaled_intrinsics(F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), F.col("page_id") + 1, F.lit(480.0), 224, 224)
    return read(spark, sf_dir, "pages").select("page_id", layout.source_kind(F.col("url")).alias("kind"), F.round(k["fx"], 6).alias("fx"))


@query(f"with {TRAJ} select vec_id, 16::int as n_values, round(action[5], 6) + 0.0 as second from traj")
def response_flatten(spark, sf_dir):
    """A nested response [4, 2, 2] as rows of four channels."""
    t = trajectory(spark, sf_dir)
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda g: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda h: F.get("action", c * 4 + g * 2 + h))))
    rows = layout.flatten_response(grid, channels_first=True)
    return t.select("vec_id", (F.size(rows) * F.size(F.get(rows, F.lit(0)))).alias("n_values"), rounded(F.get(F.get(rows, F.lit(0)), F.lit(1))).alias("second"))
