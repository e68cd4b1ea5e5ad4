"""The ``recorded_pairs`` source: folders of recorded preference pairs of every format version, as frames of one schema.

A folder with ``metadata.json`` is a pair; hidden folders are unfinished. Its version shows in its files: one HDF5 file of
both sides with arrays as NumPy bytes beside a JSON text ("stream"), archives with arrays by reference ("split"), or JSON
lines with arrays written out ("inline"). Observations come back as a skeleton, in which ``{"__array__": name}`` stands for
an array, and the arrays by name, whatever the version; the same observation gives the same row. Pickled arrays are refused.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .recordings import Tree, natural

#: The formats' file and key names: fixed values.
STREAM, SPLIT_REF, STREAM_REF, INLINE = "trajectories.h5", "__npz_ref__", "__h5_ref__", "__ndarray__"
SIDES = ("loser", "winner")
SCHEMA = (
    "pair_id string, round_id int, rollback_index int, metadata map<string,string>, version string, side string, frame_index int, ts double, source string, "
    "action array<double>, skeleton string, arrays map<string,struct<dtype:string,shape:array<int>,values:array<double>>>"
)
ARRAY = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
ARROW = pa.schema(
    [("pair_id", pa.string()), ("round_id", pa.int32()), ("rollback_index", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string())), ("version", pa.string()), ("side", pa.string()), ("frame_index", pa.int32())]
    + [("ts", pa.float64()), ("source", pa.string()), ("action", pa.list_(pa.float64())), ("skeleton", pa.string()), ("arrays", pa.map_(pa.string(), ARRAY))]
)
ROWS_OUT = 256


def restored(value, find, path: str, arrays: dict[str, np.ndarray]):
    """The skeleton of an observation; its arrays go to ``arrays`` by their place in it. ``find`` gives an array or None."""
    found = find(value)
    if found is not None:
        arrays[path] = np.asarray(found)
        return {"__array__": path}
    if isinstance(value, dict):
        return {k: restored(v, find, f"{path}/{k}" if path else str(k), arrays) for k, v in value.items()}
    if isinstance(value, list):
        return [restored(v, find, f"{path}/{i}" if path else str(i), arrays) for i, v in enumerate(value)]
    return value


def by_reference(key: str, load):
    return lambda value: load(value[key]) if isinstance(value, dict) and key in value else None


def inline(value):
    return np.asarray(value[INLINE], value.get("dtype")) if isinstance(value, dict) and INLINE in value else None


@dataclass
class Folder(InputPartition):
    paths: list[str]


class PairSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PairReader(self.options["path"], int(self.options.get("pairsPerPartition", 16)))


class PairReader(DataSourceReader):
    def __init__(self, path: str, per: int):
        self.path, self.per = path, per
        self.pairs: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A pair's folder does not tell its id, so its metadata is read before its arrays."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("pair_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pairs = values if self.pairs is None else self.pairs & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        listed = [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if posixpath.basename(f.path) == "metadata.json"]
        folders = sorted((posixpath.dirname(p) for p in listed), key=natural)
        shown = [d for d in folders if not any(p.startswith(".") for p in posixpath.relpath(d, root).split("/") if p != ".")]
        return [Folder(shown[k : k + self.per]) for k in range(0, len(shown), self.per)] or [Folder([])]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        for folder in partition.paths:
            held = {posixpath.basename(f.path) for f in files.get_file_info(fs.FileSelector(folder))}
            load = lambda name: files.open_input_stream(f"{folder}/{name}").read()
            meta = json.loads(load("metadata.json"))
            pair = meta.pop("pair_id")
            if self.pairs is not None and pair not in self.pairs:
                continue
            own = (pair, int(meta.pop("round_id", 1)), int(meta.pop("rollback_index")), [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in meta.items()])
            rows = []
            for side in SIDES:
                version, frames = (self._stream if STREAM in held else self._archives)(load, held, side)
                for i, (ts, source, action, observation, find) in enumerate(frames):
                    arrays: dict[str, np.ndarray] = {}
                    skeleton = json.dumps(restored(observation, find, "", arrays), sort_keys=True, separators=(",", ":"))
                    flat = [(k, {"dtype": a.dtype.str, "shape": list(a.shape), "values": np.asarray(a, float).reshape(-1)}) for k, a in sorted(arrays.items())]
                    rows.append((*own, version, side, i, float(ts), str(source), np.asarray(action, float), skeleton, flat))
            for at in range(0, len(rows), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS_OUT]), ARROW.types)], schema=ARROW)

    def _archives(self, load, held: set[str], side: str) -> tuple[str, Iterator[tuple]]:
        series = np.load(io.BytesIO(load(f"{side}.npz")), allow_pickle=False)
        lines = [json.loads(x) for x in load(f"{side}_observations.jsonl").decode().splitlines() if x.strip()]
        split = f"{side}_obs_arrays.npz" in held
        stored = np.load(io.BytesIO(load(f"{side}_obs_arrays.npz")), allow_pickle=False) if split else None
        find = by_reference(SPLIT_REF, stored.__getitem__) if split else inline
        return ("split" if split else "inline"), ((ts, source, action, o, find) for ts, source, action, o in zip(series["timestamps"], series["sources"], series["actions"], lines))

    def _stream(self, load, held: set[str], side: str) -> tuple[str, Iterator[tuple]]:
        tree = Tree(load(STREAM))
        text = lambda x: x.decode() if isinstance(x, bytes) else str(x)

        def frames() -> Iterator[tuple]:
            sources = tree.array(f"{side}/sources").reshape(-1)
            for i, (ts, action) in enumerate(zip(tree.array(f"{side}/timestamps"), tree.array(f"{side}/actions"))):
                at = f"{side}/observations/{i:08d}"
                array = lambda name, at=at: np.load(io.BytesIO(np.asarray(tree.array(f"{at}/arrays/{name}"), np.uint8).tobytes()), allow_pickle=False)
                yield ts, text(sources[i]), action, json.loads(tree.attribute(at, "json")), by_reference(STREAM_REF, array)

        return "stream", frames()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PairSource)
