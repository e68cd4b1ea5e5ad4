"""Recorded containers as tables: concatenated blobs, NumPy archives, JSON annotations, and HDF5 if ``h5py`` is installed.
Video has no reader. Files are read by Spark's binary source and decoded on executors, one file at a time.

A :class:`Layout` says which arrays of a container are states, actions and instructions, and how actions follow. Keys
resolve in order, exactly first and then as the end of a path. Pickles are never loaded.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, frame_index long, state array<double>, action array<double>, timestamp double, instruction string"


@dataclass(frozen=True)
class Layout:
    """``action`` is "column" (its own array), "next_state" (the state after, the last repeated) or "paired" (state t with
    state t + 1, one row less)."""

    name: str
    suffix: str
    state: Sequence[str] = ("state", "observation/state")
    actions: Sequence[str] = ("action",)
    action: str = "column"
    clock: Sequence[str] = ("timestamp", "time")
    text: Sequence[str] = ("instruction", "task")
    marker: str = ""
    limits: dict[str, int] = field(default_factory=dict)


#: Recording layouts by how they name and align their arrays.
LAYOUTS = {
    "npz": Layout("npz", ".npz"),
    "split_h5": Layout("split_h5", ".h5", ("observation/robot_state/cartesian_position",), ("action/cartesian_position", "action")),
    "demo_h5": Layout("demo_h5", ".hdf5", ("obs/ee_states", "robot_states"), action="next_state"),
    "merged_h5": Layout("merged_h5", ".hdf5", ("endpose", "joint_action/vector"), action="paired"),
    "annotated_json": Layout("annotated_json", ".json", ("state", "states"), ("action", "actions"), action="next_state", text=("texts", "instruction")),
    "prompted_h5": Layout("prompted_h5", ".hdf5", ("observations/qpos",), ("action",), text=("prompt",), marker="described here:"),
}


def resolve(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is a name, else the first that a name ends with."""
    for c in candidates:
        if c in names:
            return c
    for c in candidates:
        found = [n for n in sorted(names) if n.endswith("/" + c)]
        if found:
            return found[0]
    return None


def load_npz(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def load_json(data: bytes) -> dict[str, np.ndarray]:
    return {k: np.asarray(v) for k, v in json.loads(data).items()}


def load_hdf5(data: bytes) -> dict[str, np.ndarray]:
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 files need h5py on the executors") from e
    out: dict[str, np.ndarray] = {}
    with h5py.File(io.BytesIO(data), "r") as f:
        f.visititems(lambda name, x: out.__setitem__(name, x[()]) if isinstance(x, h5py.Dataset) else None)
    return out


def loader(suffix: str) -> Callable[[bytes], dict[str, np.ndarray]]:
    known = {".npz": load_npz, ".json": load_json, ".h5": load_hdf5, ".hdf5": load_hdf5}
    if suffix not in known:
        raise ValueError(f"no reader for {suffix} files")
    return known[suffix]


def frames_of(arrays: dict[str, np.ndarray], layout: Layout) -> dict[str, list]:
    """Aligned columns of one container, cut to its shortest array."""
    names = list(arrays)
    key = resolve(names, layout.state)
    if key is None:
        raise ValueError(f"{layout.name}: none of {list(layout.state)} in {sorted(names)}")
    state = np.asarray(arrays[key], float).reshape(len(arrays[key]), -1)
    own = resolve(names, layout.actions)
    if layout.action == "column" and own:
        action = np.asarray(arrays[own], float).reshape(len(arrays[own]), -1)
    elif layout.action == "paired":
        state, action = state[:-1], state[1:]
    else:
        action = np.concatenate([state[1:], state[-1:]])
    clock = resolve(names, layout.clock)
    times = np.asarray(arrays[clock], float).reshape(-1) if clock else np.full(len(state), np.nan)
    n = min(len(state), len(action), len(times))
    words = resolve(names, layout.text)
    said = str(np.asarray(arrays[words]).reshape(-1)[0]) if words and np.asarray(arrays[words]).size else ""
    if layout.marker and layout.marker in said:
        said = said.partition(layout.marker)[2]
    rel = times[:n] - times[0] if n and not np.isnan(times[0]) else times[:n]
    return {"frame_index": list(range(n)), "state": list(state[:n]), "action": list(action[:n]), "timestamp": list(rel), "instruction": [said.strip()] * n}


def read_layout(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """(path, frame_index, state, action, timestamp, instruction) of all containers below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{layout.suffix}").load(path).select("path", "content")
    load = loader(layout.suffix)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield pd.DataFrame({"path": name} | frames_of(load(bytes(content)), layout))

    rows = files.mapInPandas(decode, SCHEMA)
    return rows.withColumn("timestamp", F.nanvl("timestamp", F.lit(None).cast("double")))


def split_blob(df: DataFrame, blob: str, sizes: str, by: Sequence[str]) -> DataFrame:
    """(by, position, data): the parts of a concatenated blob by their sizes; an error if they exceed it."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    checked = df.withColumn("_e", F.assert_true(total <= F.octet_length(blob), F.lit("the parts are larger than the blob")))
    each = checked.where("_e is null").select(*by, blob, F.posexplode(sizes).alias("position", "size"))
    offset = F.sum("size").over(Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return each.withColumn("_o", offset).select(*by, "position", F.substring(F.col(blob), (F.col("_o") + 1).cast("int"), F.col("size").cast("int")).alias("data"))


def size_stats(parts: DataFrame, data: str, by: Sequence[str]) -> DataFrame:
    """Least, greatest and mean encoded size."""
    n = F.octet_length(data)
    return parts.groupBy(*by).agg(F.min(n).alias("low"), F.max(n).alias("high"), F.avg(n).alias("mean"))


def first_camera(cameras: DataFrame, by: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """The first of the candidate cameras that each episode has."""
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col("camera"))
    return cameras.where(rank > 0).groupBy(*by).agg(F.min_by("camera", rank).alias("camera"))
