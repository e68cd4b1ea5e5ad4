"""The ``live`` source: messages of cameras, controllers and policies as a stream that can be replayed.

Devices cannot be asked twice, so what they say goes to a spool first: a folder of numbered segments for each topic, each
published whole (:class:`Spool`). The stream's offset is the next message number of each topic. A query that restarts from its checkpoint
reads the same numbers again, and a batch read of the spool is its twin. ``maxRows`` bounds what a micro-batch takes from
a topic; ``retain=false`` drops segments once they are committed.

Segments hold JSON lines (seq, stamp in seconds, payload as text); one segment is one file and one task reads whole files.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kinelake.sources.recordings import write_file

SCHEMA = "topic string, seq long, stamp timestamp, payload string"
ARROW = pa.schema([("topic", pa.string()), ("seq", pa.int64()), ("stamp", pa.timestamp("us", tz="UTC")), ("payload", pa.string())])
SEGMENT = re.compile(r"^(\d{20})-(\d+)\.jsonl$")
ROWS_OUT = 4096


class Spool:
    """The writing side. A segment with messages ``first`` onwards is one file; a repeated write replaces it by itself."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def append(self, topic: str, first: int, messages: Sequence[tuple[float, str]]) -> int:
        """Publishes (stamp, payload) messages and gives the number after the last."""
        if "/" in topic or not topic:
            raise ValueError("a topic is a folder's name")
        lines = "".join(json.dumps({"seq": first + k, "stamp": stamp, "payload": payload}) + "\n" for k, (stamp, payload) in enumerate(messages))
        write_file(f"{self.path}/{topic}/{first:020d}-{len(messages)}.jsonl", lines.encode())
        return first + len(messages)

    def poll(self, topic: str, ask: Callable[[], str | None], times: int, interval: float = 0.0, first: int = 0, clock: Callable[[], float] = time.time) -> int:
        """Asks a device ``times`` times and publishes what it says; a device that says nothing leaves no message."""
        for _ in range(times):
            said = ask()
            if said is not None:
                first = self.append(topic, first, [(clock(), said)])
            if interval:
                time.sleep(interval)
        return first


def segments(path: str) -> dict[str, list[tuple[int, int, str]]]:
    """(first, behind the last, file) of every topic's segments in order."""
    files, root = fs.FileSystem.from_uri(path)
    found: dict[str, list[tuple[int, int, str]]] = {}
    for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        named = SEGMENT.match(posixpath.basename(f.path))
        if named and f.type == fs.FileType.File:
            first = int(named[1])
            found.setdefault(posixpath.basename(posixpath.dirname(f.path)), []).append((first, first + int(named[2]), f.path))
    return {topic: sorted(s) for topic, s in sorted(found.items())}


@dataclass
class Range(InputPartition):
    topic: str
    start: int
    end: int
    files: list[str]


def ranges(held: dict[str, list[tuple[int, int, str]]], start: dict[str, int], end: dict[str, int]) -> list[Range]:
    """One partition for each segment that has messages from ``start`` to before ``end``."""
    out = []
    for topic, stop in end.items():
        low = start.get(topic, 0)
        out += [Range(topic, max(low, a), min(stop, b), [f]) for a, b, f in held.get(topic, []) if a < stop and b > low]
    return out


def read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    files, _ = fs.FileSystem.from_uri(path)
    rows = []
    for name in part.files:
        for line in files.open_input_stream(name).read().splitlines():
            m = json.loads(line)
            if part.start <= m["seq"] < part.end:
                rows.append((part.topic, m["seq"], round(m["stamp"] * 1e6), m["payload"]))
    for at in range(0, len(rows), ROWS_OUT):
        columns = list(zip(*rows[at : at + ROWS_OUT]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) if t == ARROW.types[2] else pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


class LiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SpoolReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LiveReader(self.options["path"], int(self.options.get("maxRows", 1 << 62)), self.options.get("retain", "true").lower() != "false")


class SpoolReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        held = segments(self.path)
        return ranges(held, {}, {t: s[-1][1] for t, s in held.items()}) or [Range("", 0, 0, [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)


class LiveReader(DataSourceStreamReader):
    """Offsets are message numbers by topic. Numbers are dense in a topic; a batch ends before a gap, which may still be filled."""

    def __init__(self, path: str, most: int, retain: bool):
        self.path, self.most, self.retain = path, most, retain
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        end = dict(self.at)
        for topic, held in segments(self.path).items():
            low = n = self.at.get(topic, held[0][0])
            for first, behind, _ in held:
                if first > n:
                    break
                n = max(n, behind)
            end[topic] = min(n, low + self.most)
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = {t: max(n, self.at.get(t, 0)) for t, n in end.items()}
        return ranges(segments(self.path), start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)

    def commit(self, end: dict) -> None:
        self.at = {t: max(n, self.at.get(t, 0)) for t, n in end.items()}
        if not self.retain:
            files, _ = fs.FileSystem.from_uri(self.path)
            for topic, held in segments(self.path).items():
                for _, behind, name in held:
                    if behind <= end.get(topic, 0):
                        files.delete_file(name)

    def stop(self) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LiveSource)


def publish(path: str, topic: str, rows: Iterable[tuple[int, float, str]], size: int = 1000) -> int:
    """Publishes numbered rows (seq, stamp, payload), in order and without gaps, as segments of ``size``."""
    spool, held, first, n = Spool(path), [], None, 0
    for seq, stamp, payload in rows:
        first = seq if first is None else first
        held.append((stamp, payload))
        n += 1
        if len(held) == size:
            first, held = spool.append(topic, first, held), []
    if held:
        spool.append(topic, first, held)
    return n
