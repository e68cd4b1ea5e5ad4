"""The ``recording`` data source: containers of recorded episodes as rows of frames.

``spark.read.format("recording").option("layout", "demo_h5").load(path)`` gives one row for each frame of each episode, with
the container's arrays by name; :mod:`kinelake.operators.recordings` aligns them to states and actions as windows. A layout
says which files are containers, how episodes fan out of them, and where split, instruction and arrays are found.

Planning lists files and packs containers into partitions of ``partitionBytes``; a container is read by one task, which
loads only the arrays of its layout. Equality and membership of ``split``, ``episode`` and ``container`` and substrings of
``instruction`` are pushed down: what the path tells is decided while planning, the rest before an array is loaded.

Containers are recognised by their first bytes: HDF5 (where ``h5py`` is installed on the executors) or a NumPy archive with
the same inner paths and attributes below ``@``. Pickled step lists are read by an unpickler that knows arrays only.
``option("errors", "report")`` adds a column ``error``: a container or episode that cannot be read gives one row with the
fault and no frame, and the others go on; by default the fault ends the job. An episode is whole or a fault.
Files are opened through pyarrow's file systems, so paths are local, hdfs, s3 or gs addresses that the executors share.
"""

from __future__ import annotations

import fnmatch
import io
import json
import pickle
import posixpath
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains

SCHEMA = "container string, split string, episode string, instruction string, frame_index long, arrays map<string,array<double>>, cameras map<string,string>"
#: The column of ``option("errors", "report")``.
ERROR = "error"
ARROW = pa.schema([("container", pa.string()), ("split", pa.string()), ("episode", pa.string()), ("instruction", pa.string()), ("frame_index", pa.int64()), ("arrays", pa.map_(pa.string(), pa.list_(pa.float64()))), ("cameras", pa.map_(pa.string(), pa.string()))])
#: Bytes of containers that share a partition, and frames of a record batch.
PARTITION_BYTES, FRAMES_OUT = 64 << 20, 512


@dataclass(frozen=True)
class Layout:
    """``files``: names of containers. ``fan``: "file" (an episode each), "demos" (one for each group below ``data``) or
    "images" (one for each folder of images beside step lists). ``arrays``: candidates by name, the first that is there
    counts; they may end a longer inner path. ``cameras``: inner paths of image streams."""

    files: str
    arrays: dict[str, tuple[str, ...]]
    fan: str = "file"
    recursive: bool = True
    split: str = ""
    sidecar: tuple[str, str] = ("", "")
    said: tuple[str, ...] = ()
    marker: str = ""
    named: str = "file"
    cameras: dict[str, str] = field(default_factory=dict)


#: How recorders lay out their containers; fixed values. ``{device}`` is an option.
LAYOUTS = {
    "dual_arm_h5": Layout(
        "*.hdf5",
        {f"{kind}_{side}_{part}": (f"{folder}/{{device}}_{part}_{side}",) for kind, folder in (("command", "command_poses_dict"), ("state", "poses_dict")) for side in ("left", "right") for part in ("arm", "gripper")},
        recursive=False,
        said=("@task_name",),
        named="root",
    ),
    "split_h5": Layout(
        "trajectory.h5",
        {
            "state_pose": ("observation/robot_state/cartesian_position", "observation/cartesian_position", "robot_state/cartesian_position", "cartesian_position"),
            "state_gripper": ("observation/robot_state/gripper_position", "observation/gripper_position", "robot_state/gripper_position", "gripper_position"),
            "action_pose": ("action/cartesian_position", "action/target_cartesian_position", "action/cartesian_velocity", "target_cartesian_position", "cartesian_velocity"),
            "action_gripper": ("action/gripper_position", "action/target_gripper_position", "action/gripper_velocity", "target_gripper_position", "gripper_velocity"),
        },
        split="success",
        sidecar=("metadata_*.json", "current_task"),
        named="",
    ),
    "demo_h5": Layout("*.hdf5", {"position": ("obs/ee_pos",), "euler": ("obs/ee_ori",), "gripper": ("obs/gripper_states",)}, fan="demos", named="task", cameras={"main": "obs/agentview_rgb", "left_wrist": "obs/eye_in_hand_rgb"}),
    "merged_h5": Layout(
        "episode*.hdf5",
        {"left_pose": ("endpose/left_endpose",), "right_pose": ("endpose/right_endpose",), "left_gripper": ("endpose/left_gripper",), "right_gripper": ("endpose/right_gripper",), "qpos": ("observations/qpos",), "action": ("action",)},
        said=("instruction",),
        named="folder",
    ),
    "annotated_json": Layout("*.json", {"state": ("state",), "action": ("action",), "gripper": ("continuous_gripper_state",)}, split="train", said=("texts", "task"), named=""),
    "prompted_h5": Layout(
        "episode_*.hdf5",
        {"left_pose": ("puppet/end_effector_left_pose_align/data",), "right_pose": ("puppet/end_effector_right_pose_align/data",), "left_gripper": ("puppet/end_effector_left_position_align/data",), "right_gripper": ("puppet/end_effector_right_position_align/data",)},
        said=("prompts", "metadata/language_instruction"),
        marker="described here:",
        named="folder",
        cameras={"main": "observations/images/cam_high", "left_wrist": "observations/images/cam_left", "right_wrist": "observations/images/cam_right"},
    ),
    "image_folders": Layout("policy_out.pkl", {"state": ("obs/state",), "action": ("policy/actions",), "eef": ("obs/eef_transform",), "robot": ("policy/new_robot_transform",)}, fan="images", sidecar=("lang.txt", ""), named=""),
}


class StepUnpickler(pickle.Unpickler):
    """Loads arrays, numbers and plain containers; any other name in the stream is an error."""

    KNOWN = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self.KNOWN:
            raise pickle.UnpicklingError(f"{module}.{name} is not an array")
        return super().find_class(module, name)


class Tree:
    """The arrays and attributes of one container by inner path; arrays load when asked for."""

    def __init__(self, data: bytes):
        if data[:4] == b"\x89HDF":
            try:
                import h5py
            except ImportError as e:
                raise RuntimeError("HDF5 files need h5py on the executors") from e
            self._file = h5py.File(io.BytesIO(data), "r")
            self.names: list[str] = []
            self._file.visititems(lambda name, x: self.names.append(name) if isinstance(x, h5py.Dataset) else None)
            self.names += [f"@{k}" for k in self._file.attrs]
            self._get = lambda name: self._file.attrs[name[1:]] if name[0] == "@" else self._file[name][()]
        elif data[:2] == b"PK":
            self._file = np.load(io.BytesIO(data), allow_pickle=False)
            self.names, self._get = list(self._file.files), self._file.__getitem__
        else:
            held = {k: v for k, v in json.loads(data).items()}
            self.names, self._get = list(held), held.__getitem__

    def find(self, candidates: Sequence[str], below: str = "") -> str | None:
        """The first candidate that is a name, else the first that ends one, below a group."""
        inside = sorted(n for n in self.names if n.startswith(below))
        return next((below + c for c in candidates if below + c in inside), None) or next((n for c in candidates for n in inside if n.endswith("/" + c)), None)

    def array(self, name: str) -> np.ndarray:
        return np.asarray(self._get(name))

    def text(self, name: str) -> str:
        values = np.asarray(self._get(name)).reshape(-1)
        said = values[0] if len(values) else ""
        return (said.decode() if isinstance(said, bytes) else str(said)).strip()

    def attribute(self, group: str, key: str) -> str:
        """An attribute of a group, as text; in an archive it is an array below ``@``."""
        if f"{group}@{key}" in self.names:
            return self.text(f"{group}@{key}")
        value = self._file[group].attrs[key]
        return value.decode() if isinstance(value, bytes) else str(value)

    def groups(self, below: str) -> list[str]:
        return sorted({n[len(below) :].split("/", 1)[0] for n in self.names if n.startswith(below) and "/" in n[len(below) :]})


class StepTree(Tree):
    """Pickled step lists: a mapping of arrays, or one mapping for each step."""

    def __init__(self, parts: dict[str, bytes]):
        self._held: dict[str, np.ndarray] = {}
        for part, data in parts.items():
            steps = StepUnpickler(io.BytesIO(data)).load()
            keys = steps if isinstance(steps, dict) else sorted(set().union(*steps)) if steps else ()
            for key in keys:
                self._held[f"{part}/{key}"] = np.asarray(steps[key] if isinstance(steps, dict) else [s[key] for s in steps if key in s])
        self.names, self._get = list(self._held), self._held.__getitem__


@dataclass
class Packed(InputPartition):
    containers: list[tuple[str, str, str, list[str]]]  # path, split, instruction of the path, image folders


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return f"{SCHEMA}, {ERROR} string" if reports(dict(self.options)) else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(dict(self.options))


def reports(options: dict[str, str]) -> bool:
    kind = next((v for k, v in options.items() if k.lower() == "errors"), "raise")
    if kind not in ("raise", "report"):
        raise ValueError("errors must be 'raise' or 'report'")
    return kind == "report"


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        lower = {k.lower(): v for k, v in options.items()}
        if lower.get("layout") not in LAYOUTS:
            raise ValueError(f"layout must be one of {sorted(LAYOUTS)}")
        self.layout = LAYOUTS[lower["layout"]]
        self.path, self.device = lower["path"], lower.get("device", "robot")
        self.splits = {s.strip() for s in lower.get("split", "").split(",") if s.strip()} or ({self.layout.split} if self.layout.split else set())
        self.tasks = [t.strip().lower() for t in lower.get("tasks", "").split(",") if t.strip()]
        self.reports = reports(options)
        self.bytes = int(lower.get("partitionbytes", PARTITION_BYTES))
        self.equal: dict[str, set] = {}
        self.contains: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringContains)) and len(f.attribute) == 1 else ""
            if isinstance(f, (EqualTo, In)) and column in ("split", "episode", "container"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[column] = self.equal.get(column, values) & values
            elif isinstance(f, StringContains) and column == "instruction":
                self.contains.append(f.value)
            else:
                yield f

    def _may(self, column: str, value: str) -> bool:
        return column not in self.equal or value in self.equal[column]

    def _wanted(self, instruction: str, *names: str) -> bool:
        texts = [t.lower() for t in (instruction, *names) if t]
        return all(c in instruction for c in self.contains) and (not self.tasks or any(t in x for t in self.tasks for x in texts))

    def partitions(self) -> Sequence[InputPartition]:
        """Containers in natural order of their paths, packed by bytes."""
        files, root = fs.FileSystem.from_uri(self.path)
        listed = [f for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        sizes, by_folder = {f.path: f.size for f in listed}, {}
        for f in listed:
            by_folder.setdefault(posixpath.dirname(f.path), []).append(posixpath.basename(f.path))
        packs: list[Packed] = []
        held = self.bytes
        found = [p for p in sizes if fnmatch.fnmatch(posixpath.basename(p), self.layout.files)]
        if self.layout.fan == "demos" and any(posixpath.dirname(p) == root.rstrip("/") for p in found):
            found = [p for p in found if posixpath.dirname(p) == root.rstrip("/")]  # files of the root itself have no split
            splits: set[str] = set()
        else:
            splits = self.splits
        for path in sorted(found, key=natural):
            folder = posixpath.dirname(path)
            inside = posixpath.relpath(folder, root).split("/")
            split = next((s for s in sorted(splits) if s in inside), "")
            if (splits and not split) or (not self.layout.recursive and folder != root.rstrip("/")) or not self._may("split", split) or not self._may("container", path):
                continue
            images: list[str] = []
            if self.layout.fan == "images":
                images = sorted((posixpath.basename(d) for d, names in by_folder.items() if posixpath.dirname(d) == folder and posixpath.basename(d).startswith("images") and any(fnmatch.fnmatch(n, "im_*.jpg") for n in names)), key=natural)
                if "obs_dict.pkl" not in by_folder[folder] or not images:
                    continue
            named = self._named(path, root)
            if named and not self.layout.said and not self._wanted(named, posixpath.basename(path), folder):
                continue
            if held + sizes[path] > self.bytes or not packs:
                packs.append(Packed([]))
                held = 0
            packs[-1].containers.append((path, split, named, images))
            held += sizes[path]
        return packs or [Packed([])]

    def _named(self, path: str, root: str) -> str:
        """The instruction that names alone give."""
        kind, folder = self.layout.named, posixpath.dirname(path)
        if kind == "folder":
            parent = posixpath.basename(folder)
            parts = (posixpath.basename(posixpath.dirname(folder)) if parent == "data" else parent).split("_")
            core = "_".join(parts[4:-2]).strip("_") if len(parts) > 4 else ""
            return (core or "_".join(parts)).replace("_", " ").strip()
        name = {"file": path, "task": path, "root": root.rstrip("/")}.get(kind, "")
        stem = posixpath.splitext(posixpath.basename(name))[0] if kind != "root" else posixpath.basename(name)
        return (stem.replace("_demo", "") if kind == "task" else stem).replace("_", " ").strip()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(self.path)
        for path, split, named, images in partition.containers:
            if not self.reports:
                for _, batches in self._episodes(files, root, path, split, named, images):
                    yield from batches
                continue
            at = None
            try:
                for at, batches in self._episodes(files, root, path, split, named, images):
                    try:
                        whole = [b.append_column(ERROR, pa.nulls(len(b), pa.string())) for b in batches]
                    except Exception as e:  # whatever a broken episode raises
                        whole = [self._fault(path, split, at, e)]
                    yield from whole
            except Exception as e:  # or a broken container
                if self._may("episode", ""):
                    yield self._fault(path, split, None, e)

    def _fault(self, path: str, split: str, episode: str | None, fault: Exception) -> pa.RecordBatch:
        row = {"container": path, "split": split, "episode": episode, ERROR: f"{type(fault).__name__}: {fault}"}
        return pa.RecordBatch.from_pylist([row], schema=ARROW.append(pa.field(ERROR, pa.string())))

    def _episodes(self, files, root: str, path: str, split: str, named: str, images: list[str]) -> Iterator[tuple[str, Iterator[pa.RecordBatch]]]:
        """The wanted episodes of a container, each with its frames."""
        folder = posixpath.dirname(path)
        load = lambda p: files.open_input_stream(p).read()
        if self.layout.fan == "images":
            tree: Tree = StepTree({"obs": load(f"{folder}/obs_dict.pkl"), "policy": load(path)})
        else:
            tree = Tree(load(path))
        said = self._said(tree, files, folder, load) or named
        relative = posixpath.relpath(path if self.layout.fan == "file" and not self.layout.sidecar[0] else folder, root)
        if self.layout.fan == "demos":
            episodes = [(f"{posixpath.basename(path)}::{g}", f"data/{g}/", {}) for g in tree.groups("data/")]
        elif self.layout.fan == "images":
            episodes = [(f"{relative}::{i}", "", {"main": f"{folder}/{i}"}) for i in images]
        else:
            episodes = [(relative, "", {})]
        for episode, below, cameras in episodes:
            if self._may("episode", episode) and self._wanted(said, episode, posixpath.basename(path), folder):
                cameras = cameras or {k: f"{path}::{below}{inner}" for k, inner in self.layout.cameras.items() if below + inner in tree.names}
                yield episode, self._frames(tree, path, split, episode, said, below, cameras)

    def _said(self, tree: Tree, files, folder: str, load) -> str:
        pattern, key = self.layout.sidecar
        if pattern:
            beside = sorted(f.path for f in files.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(posixpath.basename(f.path), pattern))
            try:
                return (str(json.loads(load(beside[0])).get(key, "")) if key else load(beside[0]).decode()).strip() if beside else ""
            except ValueError:
                return ""
        for name in self.layout.said:
            if name in tree.names and (text := tree.text(name)):
                at = text.lower().find(self.layout.marker) if self.layout.marker else -1
                return text[at + len(self.layout.marker) :].strip() if at >= 0 else text
        return ""

    def _frames(self, tree: Tree, path: str, split: str, episode: str, said: str, below: str, cameras: dict[str, str]) -> Iterator[pa.RecordBatch]:
        arrays = {}
        for name, candidates in self.layout.arrays.items():
            inner = tree.find([c.format(device=self.device) for c in candidates], below)
            if inner is not None:
                values = tree.array(inner)
                arrays[name] = np.asarray(values, float).reshape(len(values), -1)
        longest = max((len(a) for a in arrays.values()), default=0)
        for at in range(0, longest, FRAMES_OUT):
            rows = range(at, min(at + FRAMES_OUT, longest))
            n = len(rows)
            maps = [[(k, a[i]) for k, a in arrays.items() if i < len(a)] for i in rows]
            columns = [[path] * n, [split] * n, [episode] * n, [said] * n, list(rows), maps, [list(cameras.items())] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


def natural(path: str) -> list:
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.split(r"(\d+)", path)]


def register(spark: SparkSession) -> None:
    """Makes ``format("recording")`` known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


def write_file(path: str, data: bytes) -> None:
    """A whole file at once: readers see the old one, none, or all of it."""
    files, name = fs.FileSystem.from_uri(path)
    files.create_dir(posixpath.dirname(name), recursive=True)
    with files.open_output_stream(name + ".part") as out:
        out.write(data)
    files.move(name + ".part", name)


def archive(arrays: dict[str, np.ndarray]) -> bytes:
    """A NumPy archive with inner paths as names."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()
