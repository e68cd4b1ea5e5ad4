"""Preference pairs: nested observations as a JSON skeleton and a table of array blobs, each kept once.

Tables: ``pairs`` (pair_id, round_id, rollback_index, metadata), ``pair_frames`` (pair_id, side, frame_index, ts, source,
state, action, skeleton) and ``blobs`` (digest, dtype, shape, data). Blobs are equal by content. The pairs table is
written last, so a listing shows finished pairs only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "pair_id string, side string, frame_index int, ts double, source string, state array<float>, action array<float>, skeleton string"
PAIRS = "pair_id string, round_id int, rollback_index int, metadata map<string,string>"
BLOBS = "digest string, dtype string, shape array<int>, data binary"
#: Kinds of arrays that may be stored: bool, signed and unsigned integers, floats, bytes. Never objects.
KINDS = "biufS"


def split_observation(value: Any, blobs: dict[str, tuple]) -> Any:
    """The JSON skeleton of a nested observation; arrays go to ``blobs`` by digest."""
    if isinstance(value, np.ndarray):
        if value.dtype.kind not in KINDS:
            raise ValueError(f"arrays of {value.dtype} are not stored")
        value = np.ascontiguousarray(value)
        head = f"{value.dtype.str}{value.shape}".encode()
        digest = hashlib.sha256(head + value.tobytes()).hexdigest()
        blobs[digest] = (digest, value.dtype.str, list(value.shape), value.tobytes())
        return {"__array__": digest}
    if isinstance(value, dict):
        return {str(k): split_observation(v, blobs) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [split_observation(v, blobs) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def join_observation(skeleton: Any, blobs: dict[str, tuple]) -> Any:
    """The observation that :func:`split_observation` took apart."""
    if isinstance(skeleton, dict):
        if set(skeleton) == {"__array__"}:
            _, dtype, shape, data = blobs[skeleton["__array__"]]
            if np.dtype(dtype).kind not in KINDS:
                raise ValueError(f"arrays of {dtype} are not read")
            return np.frombuffer(bytes(data), dtype).reshape(shape)
        return {k: join_observation(v, blobs) for k, v in skeleton.items()}
    return [join_observation(v, blobs) for v in skeleton] if isinstance(skeleton, list) else skeleton


def write_pair(spark: SparkSession, root: str, pair_id: str, round_id: int, losers: list[dict], winners: list[dict], rollback_index: int = 0, metadata: dict[str, str] | None = None) -> None:
    """One recorded pair: frames are dicts of ts, source, state, action and observation. Metadata never replaces the keys."""
    if not losers or not winners:
        raise ValueError("a pair needs loser and winner frames")
    blobs: dict[str, tuple] = {}
    rows = []
    for side, frames in (("loser", losers), ("winner", winners)):
        for i, f in enumerate(frames):
            state, action = (np.asarray(f[k], np.float32).reshape(16).tolist() for k in ("state", "action"))
            rows.append((pair_id, side, i, float(f["ts"]), f["source"], state, action, json.dumps(split_observation(f.get("observation", {}), blobs), separators=(",", ":"))))
    if blobs:
        spark.createDataFrame(list(blobs.values()), BLOBS).write.mode("append").parquet(f"{root}/blobs")
    spark.createDataFrame(rows, FRAMES).write.mode("append").parquet(f"{root}/pair_frames")
    own = {k: str(v) for k, v in (metadata or {}).items() if k not in ("pair_id", "round_id")}
    spark.createDataFrame([(pair_id, round_id, rollback_index, own)], PAIRS).write.mode("append").parquet(f"{root}/pairs")


def write_pairs(frames: DataFrame, pairs: DataFrame, root: str) -> None:
    """Many recorded pairs at once: frames (pair_id, side, frame_index, ts, source, state, action, observation as arrays by
    name) and pairs (pair_id, round_id). Executors take observations apart; each blob is kept once; pairs come last."""
    held = frames.withColumn("_parts", F.transform(F.map_entries("observation"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    rows = held.mapInPandas(_taken_apart, f"{FRAMES}, blobs array<struct<digest:string,dtype:string,shape:array<int>,data:binary>>")
    rows.write.mode("append").parquet(f"{root}/staged")
    staged = frames.sparkSession.read.schema(rows.schema).parquet(f"{root}/staged")
    staged.select(F.inline("blobs")).dropDuplicates(["digest"]).write.mode("append").parquet(f"{root}/blobs")
    staged.drop("blobs").write.mode("append").parquet(f"{root}/pair_frames")
    out = pairs.select("pair_id", "round_id", F.lit(0).alias("rollback_index"), F.create_map().cast("map<string,string>").alias("metadata"))
    out.write.mode("append").parquet(f"{root}/pairs")


def _taken_apart(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        skeletons, found = [], []
        for entries in rows["_parts"]:
            blobs: dict[str, tuple] = {}
            skeletons.append(json.dumps(split_observation({e["key"]: np.asarray(e["value"], "<f8") for e in entries}, blobs), separators=(",", ":")))
            found.append([dict(zip(("digest", "dtype", "shape", "data"), b)) for b in blobs.values()])
        yield rows.drop(columns=["observation", "_parts"]).assign(skeleton=skeletons, blobs=found)


def floats(data: Column) -> Column:
    """The numbers of a blob of little-endian doubles."""

    @F.pandas_udf("array<double>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(bytes(b), "<f8"))

    return run(data)


def completed_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs with frames on both sides, hidden ones (a leading dot) left out, in order."""
    frames = spark.read.schema(FRAMES).parquet(f"{root}/pair_frames").groupBy("pair_id").agg(F.countDistinct("side").alias("sides"))
    pairs = spark.read.schema(PAIRS).parquet(f"{root}/pairs").where("not startswith(pair_id, '.')")
    return pairs.join(frames.where("sides = 2"), "pair_id").drop("sides").orderBy("pair_id")


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BLOBS).parquet(f"{root}/blobs").dropDuplicates(["digest"])


def validate_samples(samples: DataFrame, winner: str = "winner", loser: str = "loser") -> DataFrame:
    """Samples whose chunks have one shape; the others are an error when the column is read."""
    same = (F.size(winner) == F.size(loser)) & F.forall(F.zip_with(winner, loser, lambda a, b: F.size(a) == F.size(b)), lambda ok: ok)
    return samples.withColumn("_ok", F.assert_true(same, F.lit("winner and loser chunks differ in shape"))).where("_ok is null").drop("_ok")
