"""The live source, silence timers and the step log: replays, gaps, late rows, faults, aborts."""

import json

import pytest
from pyspark.sql import functions as F

from kinelake.plans.stream_queries import run
from kinelake.streaming import live, silence, steplog


def stream(spark, path, **options):
    live.register(spark)
    return spark.readStream.format("live").options(**options).load(str(path))


def numbers(df):
    return sorted((r.topic, r.seq) for r in df.collect())


def test_two_runs_from_one_checkpoint(spark, tmp_path):
    spool = live.Spool(str(tmp_path / "spool"))
    spool.append("head", 0, [(float(k), f"f{k}") for k in range(7)])
    spool.append("wrist", 0, [(0.5, "w0")])
    out = tmp_path / "out"
    start = lambda: run(spark, stream(spark, tmp_path / "spool", maxRows=3).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "cp")))
    start()
    assert numbers(spark.read.parquet(str(out / "rows"))) == [("head", k) for k in range(7)] + [("wrist", 0)]
    spool.append("head", 9, [(9.0, "f9")])  # a gap: 7 and 8 are still to come
    start()
    assert ("head", 9) not in numbers(spark.read.parquet(str(out / "rows")))
    spool.append("head", 7, [(7.0, "f7"), (8.0, "f8")])
    spool.append("late-topic", 0, [(1.25, "x")])
    start()
    got = spark.read.parquet(str(out / "rows"))
    twin = spark.read.format("live").load(str(tmp_path / "spool"))
    assert sorted(map(str, got.collect())) == sorted(map(str, twin.collect())) and got.count() == 12


def test_offsets_in_one_place(tmp_path):
    spool = live.Spool(str(tmp_path))
    spool.append("a", 0, [(0.0, "0"), (1.0, "1"), (2.0, "2")])
    reader = live.LiveReader(str(tmp_path), 2, retain=False)
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a": 2}
    parts = reader.partitions({}, {"a": 2})
    assert [(p.start, p.end) for p in parts] == [(0, 2)] and sum(b.num_rows for b in reader.read(parts[0])) == 2
    again = live.LiveReader(str(tmp_path), 2, retain=False)  # a restart plans the same batch again
    assert [(p.start, p.end, p.files) for p in again.partitions({}, {"a": 2})] == [(p.start, p.end, p.files) for p in parts]
    assert again.latestOffset() == {"a": 3}
    again.commit({"a": 2})
    assert live.segments(str(tmp_path))["a"]  # its last message is not committed yet
    again.commit({"a": 3})
    assert live.segments(str(tmp_path)) == {}
    spool.append("a", 3, [(3.0, "3")])
    assert again.latestOffset() == {"a": 4}


def test_poll_and_names(tmp_path):
    said = iter(["x", None, "y"])
    spool = live.Spool(str(tmp_path))
    assert spool.poll("quest", lambda: next(said), 3, clock=lambda: 5.0) == 2
    assert [len(held) for held in live.segments(str(tmp_path)).values()] == [2]
    with pytest.raises(ValueError):
        spool.append("a/b", 0, [])
    assert live.segments(str(tmp_path / "none")) == {}


def test_silence_by_timer_row_and_late_row(spark, tmp_path):
    """a is silent at the end, b between two rows and at the end, c never; a late row of c changes nothing."""
    spool = live.Spool(str(tmp_path / "spool"))
    first = [(0, "a"), (0, "b"), (1, "c"), (2, "c"), (3, "c")]
    second = [(20, "c"), (21, "b"), (24, "c"), (1, "c"), (28, "c")]
    third = [(33, "c"), (36, "c")]
    at = 0
    for part in (first, second, third):
        at = spool.append("t", at, [(100.0 + s, json.dumps({"k": k})) for s, k in part])
    pick = lambda df: df.select(F.get_json_object("payload", "$.k").alias("k"), "stamp")
    out = tmp_path / "out"
    found = silence.over_stream(pick(stream(spark, tmp_path / "spool", maxRows=5)), "k", "stamp", 5.0, "1 seconds")
    run(spark, found.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "cp")).outputMode("append"))
    got = sorted((r.k, r.last_seen.timestamp() - 100, r.due.timestamp() - 100) for r in spark.read.parquet(str(out / "rows")).collect())
    assert got == [("a", 0.0, 5.0), ("b", 0.0, 5.0), ("b", 21.0, 26.0), ("c", 3.0, 8.0)]
    twin = silence.over_table(pick(spark.read.format("live").load(str(tmp_path / "spool"))), "k", "stamp", 5.0, 1.0)
    assert sorted((r.k, r.last_seen.timestamp() - 100, r.due.timestamp() - 100) for r in twin.collect()) == got


STEPS = "episode long, step long, executed_action16 array<double>, command_sent boolean"


def some(spark, episodes, n=3):
    return spark.createDataFrame([(e, s, [float(s)] * 16, s != 1) for e in episodes for s in range(n)], STEPS)


def seen(spark, path):
    return sorted((r.episode, r.step) for r in steplog.read(spark, path).collect())


def test_log_replays_faults_and_aborts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert seen(spark, path) == []
    rows = steplog.steps(some(spark, [1, 2]))
    steplog.write_batch(rows, 0, path)
    steplog.write_batch(rows, 0, path)  # delivered again
    assert seen(spark, path) == [(e, s) for e in (1, 2) for s in range(3)]
    rows.write.parquet(f"{path}/steps/batch=1/attempt=lost")  # stopped before its commit
    assert len(seen(spark, path)) == 6
    steplog.write_batch(steplog.steps(some(spark, [3])), 1, path)
    assert seen(spark, path) == [(e, s) for e in (1, 2, 3) for s in range(3)]
    steplog.abort(some(spark, [2]), path)
    steplog.write_batch(steplog.steps(some(spark, [2], 5)), 2, path)  # still running when it was aborted
    assert seen(spark, path) == [(e, s) for e in (1, 3) for s in range(3)]
    steplog.vacuum(spark, path, str(tmp_path / "small"))
    assert seen(spark, str(tmp_path / "small")) == seen(spark, path)
    assert {(r.step, r.skipped_execution) for r in steplog.read(spark, path).collect()} == {(0, False), (1, True), (2, False)}


def test_log_checks_widths_and_fake_robots(spark):
    assert steplog.steps(some(spark, [1]), fake=True).where("skipped_execution").count() == 0
    assert len(steplog.steps(some(spark, [1])).columns) == 22
    wrong = spark.createDataFrame([(1, 0, [0.0] * 14, True)], STEPS)
    with pytest.raises(Exception, match="has 16 channels"):
        steplog.steps(wrong).collect()
