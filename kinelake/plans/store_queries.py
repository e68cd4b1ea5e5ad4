"""Recorded pairs of all versions, selected video frames, stores over whole tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from kinelake.operators import joins, windows
from kinelake.operators import recordings as windowed
from kinelake.sources import frames, legacy, pairs, recordings, repos, samples

from .bindings import TRAJ, read, rounded, trajectory
from .recording_queries import written
from .source_queries import workspace

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def archived(k: int, state: np.ndarray, action: np.ndarray) -> dict[str, bytes]:
    """The files of pair ``k`` in its version: the first two frames lose, the others win."""
    folder, files = f"round/pair-{k}", {}
    version = ("stream", "split", "inline")[k % 3]
    files["metadata.json"] = json.dumps({"pair_id": f"pair-{k}", "rollback_index": k, **({"round_id": k % 4 + 1} if k % 2 else {}), "note": f"n{k}"}).encode()
    tree: dict[str, np.ndarray] = {}
    for side, rows in (("loser", range(0, 2)), ("winner", range(2, len(state)))):
        seen = [{"state16": state[i].astype(np.float32), "images": {"head": np.full((2, 2), i % 256, np.uint8)}, "step": i} for i in rows]
        series = {"actions": action[list(rows)].astype(np.float32), "timestamps": np.array([i / 10 for i in rows]), "sources": np.array(["policy"] * len(rows))}
        whole = lambda o, ref: {"state16": ref(o["state16"], "state16"), "images": {"head": ref(o["images"]["head"], "head")}, "step": o["step"]}
        if version == "stream":
            tree |= {f"{side}/{name}": v for name, v in series.items()}
            for i, o in enumerate(seen):
                at = f"{side}/observations/{i:08d}"

                def ref(a, name, at=at):
                    tree[f"{at}/arrays/{name}"] = np.frombuffer(_npy(a), np.uint8)
                    return {legacy.STREAM_REF: name}

                tree[f"{at}@json"] = np.array([json.dumps(whole(o, ref))])
            continue
        files[f"{side}.npz"] = recordings.archive(series)
        held: dict[str, np.ndarray] = {}
        lines = []
        for i, o in enumerate(seen):

            def ref(a, name, i=i):
                if version == "inline":
                    return {legacy.INLINE: a.tolist(), "dtype": a.dtype.str}
                held[f"frame_{i}_{name}"] = a
                return {legacy.SPLIT_REF: f"frame_{i}_{name}"}

            lines.append(json.dumps(whole(o, ref)))
        files[f"{side}_observations.jsonl"] = ("\n".join(lines) + "\n").encode()
        if version == "split":
            files[f"{side}_obs_arrays.npz"] = recordings.archive(held)
    if version == "stream":
        files[legacy.STREAM] = recordings.archive(tree)
    return {f"{folder}/{name}": data for name, data in files.items()} | {f".pair-{k}-tmp/metadata.json": b"{}"}


def _npy(a: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


@query(f"""with {TRAJ} select 'pair-' || episode as pair_id, ['stream', 'split', 'inline'][episode % 3 + 1] as version, case when episode % 2 = 1 then episode % 4 + 1 else 1 end as round_id, episode as rollback_index, 'n' || episode as note,
    case when frame_index < 2 then 'loser' else 'winner' end as side, case when frame_index < 2 then frame_index else frame_index - 2 end as frame_index, round(frame_index / 10.0::double, 3) as ts, round(action[16]::float::double, 5) + 0.0 as a, round(state[1]::float::double, 5) + 0.0 as s,
    4.0::double * (frame_index % 256) as pixels, '{{"images":{{"head":{{"__array__":"images/head"}}}},"state16":{{"__array__":"state16"}},"step":' || frame_index || '}}' as skeleton from traj where episode % 7 <> 5""")
def recorded_pairs(spark, sf_dir):
    """A pair for each episode, in one of three formats, read alike; a filter on the pair is pushed down."""
    legacy.register(spark)
    path = written(spark, sf_dir, archived)
    t = spark.read.format("recorded_pairs").load(path).where("cast(rollback_index as int) % 7 <> 5")
    array = lambda name: F.col("arrays")[name]["values"]
    return t.select(
        "pair_id", "version", F.col("round_id").cast("long").alias("round_id"), F.col("rollback_index").cast("long").alias("rollback_index"), F.col("metadata")["note"].alias("note"), "side", F.col("frame_index").cast("long").alias("frame_index"),
        F.round("ts", 3).alias("ts"), rounded(F.element_at("action", 16), 5).alias("a"), rounded(F.get(array("state16"), F.lit(0)), 5).alias("s"), F.aggregate(array("images/head"), F.lit(0.0), lambda s, x: s + x).alias("pixels"), "skeleton",
    )


def _weights(new: int, old: int) -> list[list[float]]:
    """Of each new place the shares of the old ones."""
    out = []
    for i in range(new):
        x = max((i + 0.5) * old / new - 0.5, 0.0)
        low, row = int(x), [0.0] * old
        row[low] += 1 - (x - low)
        row[min(low + 1, old - 1)] += x - low
        out.append(row)
    return out


def _resized(old: tuple[int, int], new: tuple[int, int]) -> str:
    """DuckDB: the resized pixels of a list p, row by row."""
    rows, columns = _weights(new[0], old[0]), _weights(new[1], old[1])
    pixel = lambda r, c: " + ".join(f"{a * b!r}::double * p[{i * old[1] + j + 1}]" for i, a in enumerate(r) for j, b in enumerate(c) if a * b)
    return "[" + ", ".join(pixel(r, c) for r in rows for c in columns) + "]"


@query(f"""with {TRAJ}, f as (select episode, frame_index, list_transform(action, lambda x: (abs(floor(x * 40))::bigint % 200)::double + (case when episode % 2 = 0 then 1 else 0 end)) as p from traj where frame_index % 3 = 0)
    select episode, frame_index, round(list_sum(list_transform({_resized((4, 4), (3, 6))}, lambda x, i: x * i)), 2) as total from f""")
def frames_resized(spark, sf_dir):
    """Every third frame of a video for each episode, resized from 4 x 4 to 3 x 6; the sidecar of even ones counts before the video."""

    def each(k, state, action):
        pixels = (np.abs(np.floor(action.astype(float) * 40)) % 200).astype(np.uint8).reshape(-1, 4, 4, 1)
        files = {f"{k}.y4m": frames.y4m(pixels)}
        return files | ({f"{k}.y4m.npz": recordings.archive({"frames": pixels[..., 0] + np.uint8(1)})} if k % 2 == 0 else {})

    path = written(spark, sf_dir, each)
    wanted = trajectory(spark, sf_dir).where("frame_index % 3 = 0").select(F.concat(F.lit(f"{path}/"), "episode", F.lit(".y4m")).alias("path"), "frame_index")
    out = frames.selected(wanted, (3, 6))
    total = F.aggregate(F.transform(F.col("pixels").cast("array<double>"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select(F.regexp_extract("path", r"(\d+)\.y4m$", 1).cast("long").alias("episode"), "frame_index", F.round(total, 2).alias("total"))


@query("""with t as (select event_id as token, event_id // 40 as seq, (event_id // 4) % 5 - 1 as frame, (event_id // 20) % 2 as modality, (event_id // 8) % 2 as noise from events)
    select q.token as q, k.token as k from t q join t k on q.seq = k.seq where (q.modality = 0 and k.modality = 0 and q.noise = 0 and q.frame = 0 and k.frame = 0)
    or (q.modality = 0 and k.modality = 0 and q.noise = 1 and q.frame > 0 and k.frame >= 0) or (q.modality = 1 and q.noise = 1 and k.noise = 0 and k.modality = 0 and k.frame = 0)
    or (q.modality = 1 and k.modality = 1 and q.noise = 0 and k.noise = 0 and q.frame < 0 and k.frame < 0) or (q.modality = 1 and k.modality = 1 and q.noise = 1 and k.noise = 0 and k.frame < 0)
    or (q.modality = 1 and k.modality = 1 and q.noise = 1 and k.noise = 1)""")
def visibility_ranges(spark, sf_dir):
    """A mask as ranges of tokens, taken apart again."""
    e = read(spark, sf_dir, "events")
    t = e.select(F.col("event_id").alias("token"), F.expr("event_id div 40").alias("seq"), (F.expr("event_id div 4") % 5 - 1).alias("frame"), F.expr("(event_id div 20) % 2").alias("modality"), F.expr("(event_id div 8) % 2").alias("noise"))
    return joins.expanded(joins.visibility_blocks(t))


@query(f"with {TRAJ} select 'repo_' || (episode % 4) as name, count(*) as frames, count(distinct episode) as episodes from traj where episode % 4 <> 3 group by 1")
def repo_discovery(spark, sf_dir):
    """The finished repositories below a folder, with what they hold; a fourth of the episodes is in one without its info."""
    path = workspace(spark)
    t = trajectory(spark, sf_dir).withColumn("task", F.lit("task")).withColumn("timestamp", F.col("frame_index") / 10.0)
    for k in range(3):
        repos.write_repo(t.where(F.col("episode") % 4 == k), f"{path}/deep/repo_{k}", 10.0)
    t.where("episode % 4 = 3").write.parquet(f"{path}/deep/repo_3/data")
    out = None
    for row in repos.find_repos(spark, [path]).collect():  # a row for each repository
        own = repos.read_frames(spark, row.root).agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("episode_index").alias("episodes"))
        own = own.select(F.lit(row.root.rsplit("/", 1)[-1]).alias("name"), "frames", "episodes")
        out = own if out is None else out.unionByName(own)
    return out


@query("""select event_type as stage, (user_id % 3)::int as round, case when max(value) > 18 then 'error' else 'ok' end as status, count(distinct user_id) as outputs from events group by 1, 2""")
def stage_manifest(spark, sf_dir):
    """An audit row of each stage and round, with the users that it has handled as outputs."""
    path = workspace(spark)
    e = read(spark, sf_dir, "events")
    done = e.groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 3).cast("int").alias("round")).agg(F.when(F.max("value") > 18, "error").otherwise("ok").alias("status"), F.collect_set(F.col("user_id").cast("string")).alias("outputs"))
    repos.append_stages(done.withColumn("command", F.concat(F.lit("run "), "stage")), path)
    return spark.read.parquet(path).select("stage", "round", "status", F.size("outputs").cast("long").alias("outputs"))


@query(f"""with {TRAJ} select 'pair-' || episode as pair_id, (episode % 5 + 1)::int as round_id, case when frame_index < 2 then 'loser' else 'winner' end as side, (case when frame_index < 2 then frame_index else frame_index - 2 end)::int as frame_index, round(state[1]::float::double, 5) + 0.0 as x, round(action[2]::float::double, 5) + 0.0 as seen
    from traj where (select count(*) from traj u where u.episode = traj.episode) > 2""")
def pair_store(spark, sf_dir):
    """A pair for each episode, frames and blobs written by executors; the finished ones read again with their observations."""
    path = workspace(spark)
    t = trajectory(spark, sf_dir).withColumn("pair_id", F.concat(F.lit("pair-"), "episode"))
    first = F.col("frame_index") < 2
    rows = t.select("pair_id", F.when(first, "loser").otherwise("winner").alias("side"), (F.col("frame_index") - F.when(first, 0).otherwise(2)).cast("int").alias("frame_index"), F.col("frame_index").cast("double").alias("ts"), F.lit("policy").alias("source"), "state", "action", F.create_map(F.lit("seen"), F.col("action")).alias("observation"))
    pairs.write_pairs(rows, t.groupBy("pair_id").agg((F.first("episode") % 5 + 1).cast("int").alias("round_id")), path)
    frames_ = spark.read.schema(pairs.FRAMES).parquet(f"{path}/pair_frames")
    done = pairs.completed_pairs(spark, path).select("pair_id", "round_id").join(frames_, "pair_id")
    seen = F.get_json_object("skeleton", "$.seen.__array__")
    done = done.withColumn("digest", seen).join(pairs.read_blobs(spark, path).select("digest", pairs.floats(F.col("data")).alias("v")), "digest")
    return done.select("pair_id", "round_id", "side", "frame_index", rounded(F.get("state", F.lit(0)).cast("double"), 5).alias("x"), rounded(F.get("v", F.lit(1)), 5).alias("seen"))


@query(f"""with {TRAJ}, c as (select *, (episode % 3)::int as round, max(frame_index) over (partition by episode) as final from traj)
    select c.round, c.episode, count(*) as samples, 'delta' as action_representation, round(sum(c.action[1]), 4) + 0.0 as first_sum, round(sum(l.action[1]), 4) + 0.0 as last_sum
    from c join traj l on l.episode = c.episode and l.frame_index = least(c.frame_index + 3, c.final) where c.round <> 1 or c.frame_index % 2 = 0 group by 1, 2""")
def sample_rounds(spark, sf_dir):
    """Chunks of four actions as samples of three rounds; the second is written twice, and its first version does not count."""
    path = workspace(spark)
    t = windows.lookahead(trajectory(spark, sf_dir), "action", 4, ["episode"], ["frame_index"], "winner").withColumn("loser", F.col("winner"))
    t = t.select("episode", "frame_index", "winner", "loser")
    for k in (0, 1, 2):
        samples.write_samples(t.where(F.col("episode") % 3 == k), path, k, "four.json")
    samples.write_samples(t.where("episode % 3 = 1 and frame_index % 2 = 0"), path, 1, "four.json")
    at = lambda i: F.round(F.sum(F.get(F.get("winner", F.lit(i)), F.lit(0)).cast("double")), 4) + F.lit(0.0)
    return samples.read_samples(spark, path).groupBy("round", "episode", "action_representation").agg(F.count(F.lit(1)).alias("samples"), at(0).alias("first_sum"), at(3).alias("last_sum"))


@query(f"""with {TRAJ} select 'set_' || episode % 6 as dataset, case when count(*) filter (where episode % 6 = 5 and episode % 4 = 1) > 0 then 'error' else 'ok' end as status,
    count(distinct episode) filter (where not (episode % 6 = 5 and episode % 4 = 1)) as episodes, count(*) filter (where not (episode % 6 = 5 and episode % 4 = 1)) as frames,
    count(distinct episode) filter (where episode % 6 = 5 and episode % 4 = 1) as faults from traj group by 1""")
def conversion_summary(spark, sf_dir):
    """Six datasets are converted; one has containers that end too early, which are reported while all others are read."""

    def each(k, state, action):
        whole = recordings.archive({"endpose/left_endpose": action[:, :7], "observations/qpos": state})
        return {f"set_{k % 6}/episode_{k}.hdf5": whole[: len(whole) // 2] if k % 6 == 5 and k % 4 == 1 else whole}

    recordings.register(spark)
    df = spark.read.format("recording").option("layout", "merged_h5").option("errors", "report").load(written(spark, sf_dir, each))
    return windowed.conversion_summary(df, F.regexp_extract("container", r"(set_\d+)/[^/]*$", 1)).drop("error")
