import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.plans.state_queries import ShortPairs, controls
from kinelake.streaming import machines, replay

from .conftest import SMALL


@pytest.mark.parametrize("machine", [machines.Collector, machines.RateGate, machines.ErrorTrip, machines.DeadMan, machines.RingBuffer, ShortPairs])
def test_streams_give_what_tables_give(spark, machine, tmp_path):
    """Micro-batches in time order, state kept between them."""
    table = controls(spark, SMALL).cache()
    edges = table.approxQuantile("t", [0.33, 0.66], 0.01)
    parts = [table.where(F.col("t") <= edges[0]), table.where((F.col("t") > edges[0]) & (F.col("t") <= edges[1])), table.where(F.col("t") > edges[1])]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    import os
    import shutil
    import time

    (tmp_path / "feed").mkdir()
    for i in range(3):
        [name] = [f for f in os.listdir(tmp_path / f"in/{i}") if f.endswith(".parquet")]
        shutil.copy(tmp_path / f"in/{i}/{name}", tmp_path / f"feed/{i}.parquet")
        os.utime(tmp_path / f"feed/{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    out = replay.over_stream(stream, machine, "user_id", ["t", "event_id"])
    query = out.writeStream.format("memory").queryName(f"out_{machine.__name__}").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table(f"out_{machine.__name__}").select(*out.columns).collect()))
    want = sorted(map(tuple, replay.over_table(table, machine, "user_id", ["t", "event_id"]).select(*out.columns).collect()))
    assert got == want and got


def press(**kw):
    return {"event_id": 0, "failure": False, "commit": False, "trigger": 0.0, "pending": False} | kw


def test_a_pair_is_saved():
    m = machines.Collector()
    for i in range(70):
        m.tick(press(event_id=i + 1))
    assert m.tick(press(event_id=71, failure=True))["outcome"] == "rolled_back"
    assert m.state["loser"] == list(range(7, 71))
    assert m.tick(press(event_id=72, trigger=1.0))["phase"] == machines.TAKEOVER
    m.tick(press(event_id=73, trigger=1.0))
    done = m.tick(press(event_id=74, commit=True))
    assert done["outcome"] == "saved" and done["n_loser"] == 64 and done["n_winner"] == 2 and done["phase"] == machines.POLICY


def test_presses_count_on_their_edge_and_short_histories_save_nothing():
    m = machines.Collector()
    assert m.tick(press(failure=True))["outcome"] == "nothing_to_roll_back"
    m.tick(press(event_id=1, failure=True))  # held: no second press, the row counts as a step
    m.tick(press(event_id=2))
    assert m.tick(press(event_id=3, failure=True))["outcome"] == "rolled_back" and m.state["loser"] == []
    assert m.tick(press(event_id=4, commit=True))["outcome"] == "incomplete"


def test_a_press_during_takeover_discards():
    m = machines.Collector()
    m.tick(press(event_id=1))
    m.tick(press(event_id=2, failure=True))
    m.tick(press(event_id=3, trigger=1.0))
    assert m.tick(press(event_id=4, failure=True))["outcome"] == "discarded" and m.state["phase"] == machines.POLICY


def test_a_press_during_a_batch_waits_and_later_rows_are_no_loser():
    m = machines.Collector()
    for i in range(80):
        m.tick(press(event_id=i))
    assert m.tick(press(event_id=80, failure=True, pending=True))["outcome"] == "rollback_deferred"
    m.tick(press(event_id=81, pending=True))
    assert m.tick(press(event_id=82))["outcome"] == "rolled_back"
    assert m.state["loser"] == list(range(16, 80))


def test_ring_buffer_is_bounded():
    m = machines.RingBuffer()
    rows = [m.tick({"event_id": i}) for i in range(100)]
    assert rows[-1] == {"event_id": 99, "held": 72, "oldest": 28} and len(m.state["ids"]) == 72


def test_error_trip_and_generation_fence():
    m = machines.ErrorTrip()
    assert [m.tick({"event_id": 0, "failed": f})["tripped"] for f in [1, 1, 1, 1, 0, 1, 1, 1, 1, 1]] == [False] * 9 + [True]
    g = machines.GenerationFence()
    assert [g.tick({"event_id": i, "generation": n}) is not None for i, n in enumerate([1, 2, 1, 2, 3, 2])] == [True, True, False, True, True, False]


def test_silence_zeroes_a_command():
    m = machines.DeadMan()
    m.silence = 0.5
    assert [m.tick({"event_id": 0, "t": t, "value": 1.0})["held"] for t in (0.0, 0.4, 1.0, 1.2)] == [1.0, 1.0, 0.0, 1.0]
    assert np.isclose(machines.DeadMan.silence, 21600.0)


def test_a_ring_writes_the_slots_it_changed_and_a_log_what_was_added():
    class Held:
        def __init__(self):
            self.rows, self.reads, self.writes = {}, 0, 0

        def getValue(self, slot):
            self.reads += 1
            return self.rows[slot]

        def updateValue(self, slot, value):
            self.writes += 1
            self.rows[slot] = value

    held, bounds, seen = Held(), (0, 0), []
    for batch in (range(100), range(100, 103), []):
        slots = replay._Slots(held)
        ring = machines.Ring(72, *bounds, slots)
        for x in batch:
            ring.append(x)
            seen.append(x)
            assert ring.first == seen[-72:][0]
        slots.flush()
        bounds = ring.start, ring.end
    assert held.writes == 72 + 3 and held.reads == 3  # `first` reads one slot a row
    assert machines.Ring(72, *bounds, replay._Slots(held)) == seen[-72:]
    log = machines.Log(2, lambda: [7, 8])
    log.append(9)
    assert log == [7, 8, 9] and log.added == [9] and len(log) == 3
    log.clear()
    log.append(1)
    assert log == [1] and log.cleared and len(log) == 1


def test_a_long_log_and_null_keys_pass_in_batches(spark):
    """One key has nearly all rows; batches are far smaller than its log, and a machine lasts across them."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        rows = spark.range(5000).select(F.when(F.col("id") % 50 > 1, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(2)).alias("user_id"), F.col("id").alias("event_id"))
        got = replay.over_table(rows, machines.RingBuffer, "user_id", ["event_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = {}
    for r in sorted(rows.collect(), key=lambda r: r.event_id):
        own.setdefault(r.user_id, []).append(r.event_id)
    want = [(k, x, min(i + 1, 72), ids[max(0, i - 71)]) for k, ids in own.items() for i, x in enumerate(ids)]
    assert set(own) == {None, 1, 2} and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_an_empty_table_gives_no_rows(spark):
    none = controls(spark, SMALL).where("false")
    assert replay.over_table(none, machines.Collector, "user_id", ["t", "event_id"]).count() == 0
