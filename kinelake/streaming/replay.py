"""Runs state machines over a stream or over a table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .machines import Log, Machine, Ring


def _run(machine: Machine, rows: Iterable[dict]) -> list[dict]:
    out: list[dict] = []
    for row in rows:
        made = machine.tick(row)
        if made is not None:
            out += made if isinstance(made, list) else [made]
    return out


def _schema(df: DataFrame, machine: type[Machine], key: str) -> StructType:
    own = StructType([df.schema[key]])
    return StructType(own.fields + StructType.fromDDL(machine.output).fields)


def over_table(df: DataFrame, machine: type[Machine], key: str, order: Sequence[str]) -> DataFrame:
    """Each key's rows in order through a machine of its own. Spark shuffles by key and sorts; a task reads its sorted rows in
    Arrow batches and starts a new machine where the key changes, so memory is one batch and one machine, however long a
    key's log. Rows of null keys are one key's, nulls of ``order`` come last."""
    schema = _schema(df, machine, key)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if own is None or row[key] != current:
                    own, current = machine(), row[key]
                out += [{key: current, **r} for r in _run(own, [row])]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    ordered = df.repartition(F.col(key)).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order])
    return ordered.mapInArrow(run, schema)


class _Slots(dict):
    """Slots of a ring in map state: read when they are first wanted, written back once if they have changed."""

    def __init__(self, held):
        super().__init__()
        self.held, self.changed = held, set()

    def __missing__(self, slot: int) -> int:
        value = self.held.getValue((slot,))[0]
        super().__setitem__(slot, value)
        return value

    def __setitem__(self, slot: int, value: int) -> None:
        super().__setitem__(slot, value)
        self.changed.add(slot)

    def flush(self) -> None:
        for slot in self.changed:
            self.held.updateValue((slot,), (self[slot],))


def over_stream(df: DataFrame, machine: type[Machine], key: str, order: Sequence[str]) -> DataFrame:
    """The same on a stream: state by key between micro-batches, rows of a micro-batch in order.

    Scalars are one value state, each ring a map state of its slots, each log a list state. A micro-batch of a key writes the
    slots it changed and the values it appended. Rows that arrive after a later micro-batch keep arrival order: the
    operators have no event-time policy of their own.
    """
    schema = _schema(df, machine, key)
    names = schema.fieldNames()
    fresh = machine().state
    rings = [n for n, v in fresh.items() if isinstance(v, Ring)]
    logs = [n for n, v in fresh.items() if isinstance(v, Log)]

    class Keyed(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.scalars = handle.getValueState("scalars", "json string")
            self.rings = {n: handle.getMapState(n, "slot int", "id long") for n in rings}
            self.logs = {n: handle.getListState(n, "id long") for n in logs}

        def _load(self) -> Machine:
            own = machine()
            kept = json.loads(self.scalars.get()[0]) if self.scalars.exists() else {}
            for name, held in self.rings.items():
                start, end = kept.pop(name, (0, 0))
                own.state[name] = Ring(own.state[name].capacity, start, end, _Slots(held))
            for name, held in self.logs.items():
                own.state[name] = Log(kept.pop(name, 0), lambda held=held: [row[0] for row in held.get()])
            own.state |= kept
            return own

        def _store(self, own: Machine) -> None:
            kept = dict(own.state)
            for name in self.rings:
                kept[name].slots.flush()
                kept[name] = kept[name].start, kept[name].end
            for name, held in self.logs.items():
                log = kept[name]
                if log.cleared:
                    held.clear()
                if log.added:
                    held.appendList([(x,) for x in log.added])
                kept[name] = log.size
            self.scalars.update((json.dumps(kept),))

        def handleInputRows(self, group: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            own = self._load()
            batch = pd.concat(list(rows)).sort_values(list(order))  # one key's rows of one micro-batch
            out = pd.DataFrame(_run(own, batch.astype(object).where(batch.notna(), None).to_dict("records")))
            self._store(own)
            if len(out):
                out[key] = group[0]
                yield out.reindex(columns=names)

        def close(self) -> None:
            pass

    return df.groupBy(key).transformWithStateInPandas(Keyed(), outputStructType=schema, outputMode="Append", timeMode="None")


def append_committed(df: DataFrame, path: str, checkpoint: str, aborted: str = "aborted"):
    """A file sink that leaves out rows marked as aborted: each micro-batch is published whole or not at all."""
    return df.where(f"not {aborted}").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
