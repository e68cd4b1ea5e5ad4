"""Selected frames of uncompressed videos and their bilinear resizing, by executors, in blocks of frames.

A video is a YUV4MPEG2 file of full-size planes (mono or 4:4:4): each frame has its place, so only the wanted ranges are
read. A sidecar beside it (``<video>.npz`` with ``frames``, or HDF5 where ``h5py`` is installed) counts first. Compressed
video needs a decoder, which is not here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recordings import Tree

SCHEMA = "path string, frame_index long, height int, width int, channels int, pixels array<float>"
ARROW = pa.schema([("path", pa.string()), ("frame_index", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("pixels", pa.list_(pa.float32()))])
#: Frames of a video that one task reads, and that are resized together.
BLOCK, TOGETHER = 1024, 64


def bilinear(frames: np.ndarray, height: int, width: int) -> np.ndarray:
    """Frames (n, h, w, c) at another size, pixel centres aligned by area, edges repeated."""

    def places(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.maximum((np.arange(new) + 0.5) * old / new - 0.5, 0.0)
        low = np.minimum(x.astype(int), old - 1)
        return low, np.minimum(low + 1, old - 1), (x - low).astype(np.float64)

    y0, y1, v = places(height, frames.shape[1])
    x0, x1, u = places(width, frames.shape[2])
    rows = frames[:, y0] * (1 - v)[None, :, None, None] + frames[:, y1] * v[None, :, None, None]
    return rows[:, :, x0] * (1 - u)[None, None, :, None] + rows[:, :, x1] * u[None, None, :, None]


class Video:
    """A video's frames by number: from its sidecar, else from its own file."""

    def __init__(self, files: fs.FileSystem, path: str):
        beside = [p for p in (f"{path}.npz", f"{path}.h5") if files.get_file_info(p).type == fs.FileType.File]
        self.side = Tree(files.open_input_stream(beside[0]).read()).array("frames") if beside else None
        if self.side is not None:
            self.side = self.side[..., None] if self.side.ndim == 3 else self.side
            self.count = len(self.side)
            return
        self.file = files.open_input_file(path)
        head = self.file.read(256).split(b"\n", 1)[0]
        words = head.decode("ascii", "replace").split()
        if not words or words[0] != "YUV4MPEG2":
            raise ValueError(f"{path}: no reader for this video")
        said = {w[0]: w[1:] for w in words[1:]}
        self.width, self.height, self.planes = int(said["W"]), int(said["H"]), {"mono": 1, "444": 3}.get(said.get("C", ""), 0)
        if not self.planes:
            raise ValueError(f"{path}: planes of {said.get('C', '420')} are not full-size")
        self.start, self.size = len(head) + 1, self.width * self.height * self.planes
        self.count = (self.file.size() - self.start) // (6 + self.size)

    def frame(self, k: int) -> np.ndarray:
        if not 0 <= k < self.count:
            raise ValueError(f"frame {k} of {self.count} does not exist")
        if self.side is not None:
            return np.asarray(self.side[k], float)
        self.file.seek(self.start + k * (6 + self.size))
        data = self.file.read(6 + self.size)
        if data[:6] != b"FRAME\n":
            raise ValueError("frames with headers of their own are not read")
        return np.frombuffer(data[6:], np.uint8).reshape(self.planes, self.height, self.width).transpose(1, 2, 0).astype(float)


def selected(wanted: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``SCHEMA`` for the wanted (path, frame_index), each frame once; resized to (height, width) if given.

    Tasks get blocks of a video's frames, in order, and read nothing else of it. A missing frame is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, video = None, None
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for at in range(0, len(rows), TOGETHER):
                out = []
                for name, k in rows[at : at + TOGETHER]:
                    if name != path:
                        files, inner = fs.FileSystem.from_uri(name)
                        path, video = name, Video(files, inner)
                    out.append((name, k, video.frame(k)))
                for shape in {f.shape for _, _, f in out}:
                    same = [x for x in out if x[2].shape == shape]
                    block = np.stack([f for _, _, f in same])
                    block = bilinear(block, *size) if size else block
                    n, (h, w, c) = len(same), block.shape[1:]
                    columns = [[x[0] for x in same], [x[1] for x in same], [h] * n, [w] * n, [c] * n, list(block.astype(np.float32).reshape(n, -1))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, ARROW.types)], schema=ARROW)

    rows = wanted.select(F.col("path").cast("string"), F.col("frame_index").cast("long")).distinct()
    dealt = rows.withColumn("_block", F.expr(f"frame_index div {BLOCK}")).repartition("path", "_block").sortWithinPartitions("path", "frame_index")
    return dealt.select("path", "frame_index").mapInArrow(run, SCHEMA)


def y4m(frames: np.ndarray, rate: int = 30) -> bytes:
    """Frames (n, h, w, c) of bytes as an uncompressed video."""
    n, h, w, c = frames.shape
    head = f"YUV4MPEG2 W{w} H{h} F{rate}:1 Ip C{'mono' if c == 1 else '444'}\n".encode()
    return head + b"".join(b"FRAME\n" + f.transpose(2, 0, 1).astype(np.uint8).tobytes() for f in frames)
