"""What larger tables brought to light: bounded shuffles, micro-batches and pairs, numbers beyond a byte, means that tie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import augment, convert, joins, stats
from kinelake.plans import registry, store_queries, stream_queries
from kinelake.sources import legacy, recordings
from kinelake.streaming import live

from .conftest import SMALL


def test_nearest_step_moves_no_rows_and_takes_the_first_of_equals(spark):
    times = [10.0, 8.0, 8.0, 7.5, 4.0, 4.0, 1.0, 0.0]
    schedule = spark.createDataFrame([(k, float(k), t) for k, t in enumerate(times)], "step long, sigma double, timestep double")
    wants = [None, -3.0, 0.0, 0.5, 0.49, 2.5, 4.0, 5.75, 5.76, 7.75, 8.0, 9.0, 10.0, 11.0, 1e9]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(wants)], "i long, want double")
    for block in (1, 3, 32):
        out = stats.nearest_step(rows, schedule, "want", "n", block)
        got = {r.i: r.n.step for r in out.collect()}
        for i, w in enumerate(wants):
            best = min((abs(t - w) if w is not None else 0.0, k) for k, t in enumerate(times))
            assert got[i] == best[1] and out.columns == ["i", "want", "n"], (block, w)


def test_add_noise_does_not_move_events(spark):
    plan = registry.queries()["add_noise"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(want" not in plan


def test_recorded_pairs_of_more_frames_than_a_byte_counts(spark, tmp_path):
    n = 300
    state = np.zeros((n, 16))
    for k in range(3):
        for name, data in store_queries.archived(k, state, state).items():
            recordings.write_file(str(tmp_path / name), data)
    legacy.register(spark)
    rows = spark.read.format("recorded_pairs").load(str(tmp_path)).where("side = 'winner'")
    got = {(r.version, r.frame_index): r.v for r in rows.select("version", "frame_index", F.col("arrays")["images/head"]["values"].alias("v")).collect()}
    assert len(got) == 3 * (n - 2) and all(v == [float((i + 2) % 256)] * 4 for (_, i), v in got.items())


def test_micro_batches_do_not_grow_with_the_messages():
    for most in (0, 1, 5000, 10**6, 10**9):
        segment, batch = stream_queries.sizes(most)
        assert -(-most // batch) <= stream_queries.BATCHES and 1 <= segment <= stream_queries.LONGEST


def test_messages_are_numbered_by_topic_and_time(spark):
    got = stream_queries.messages(spark, SMALL, F.col("event_type")).select("topic", "seq", F.get_json_object("payload", "$.event_id").cast("long")).collect()
    want = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("event_type", "row_number() over (partition by event_type order by ts, event_id) - 1", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def states(rng, pairs, n):
    return [(p, i, [float(x) for x in rng.normal(size=16)]) for p in range(pairs) for i in range(n)]


def test_nearest_state_meets_in_blocks_and_keeps_few_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16)
    rng = np.random.default_rng(9)
    schema = "pair int, i int, s array<double>"
    lost, won = states(rng, 2, 70), states(rng, 2, 90)
    won += [(p, i + 1000, s) for p, i, s in won] + [(0, 5000, [float("nan")] * 16), (1, 5000, [1e300] * 16), (1, 5001, [0.0] * 3), (2, 7, None)]
    lost += [(0, 900, None), (1, 900, [float("inf")] * 16), (2, 0, lost[0][2])]
    losers, winners = spark.createDataFrame(lost, schema), spark.createDataFrame(won, schema)
    w = winners.select(F.col("pair").alias("p"), F.col("i").alias("j"), F.col("s").alias("t"))
    d = losers.join(w, F.col("pair") == F.col("p")).withColumn("d", joins.pose_distance(F.col("s"), F.col("t")))
    want = d.groupBy("pair", "i").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "j")).alias("m")).select("pair", "i", "m.j", F.col("m.d").cast("string"))
    got = joins.nearest_state(losers, winners, "pair", "i", "s").withColumn("distance", F.col("distance").cast("string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_equal_states_are_compared_once(spark):
    rng = np.random.default_rng(10)
    still = [(1, i, [1.0] * 16) for i in range(500)]
    schema = "pair int, i int, s array<double>"
    losers = spark.createDataFrame([(1, i, s) for _, i, s in states(rng, 1, 200)], schema)
    met = joins.nearest_candidates(losers, spark.createDataFrame(still, schema), "pair", "i", "s").collect()
    assert len(met) == 200 and {r._j for r in met} == {0}


def test_messages_of_both_runs_are_computed_once(spark, monkeypatch):
    read, times = stream_queries.spools, []
    monkeypatch.setattr(stream_queries, "spools", lambda *a: times.append(read(*a)) or times[-1])
    monkeypatch.setattr(stream_queries, "SEGMENT", 20)
    assert registry.queries()["live_messages"](spark, SMALL).count() == 1000
    (first, later), = times  # one call for both
    assert live.segments(later) == {} and all(s[-1][1] == sum(b - a for a, b, _ in s) for s in live.segments(first).values())
    rows = spark.createDataFrame([("t", i, float(i), str(i)) for i in range(45)], "topic string, seq long, stamp double, payload string")
    held = [live.segments(path)["t"] for path in read(spark, rows, 10, lambda s: s % 2, 2)]
    assert [[(a, b) for a, b, _ in s] for s in held] == [[(0, 10), (20, 30), (40, 45)], [(10, 20), (30, 40)]]


def test_cameras_with_equal_means_are_in_the_order_of_their_names(spark):
    inf, nan = float("inf"), float("nan")
    heard = {
        1: {"a": [0.3, 0.2, 0.1], "b": [0.1, 0.2, 0.3], "c": [0.2]},  # sums of doubles: a least
        2: {"a": [0.1] * 3, "b": [0.1] * 10, "c": [0.1], "d": [None], "e": [nan, 0.2]},
        3: {"a": [1.0], "b": [inf], "c": [1e300], "d": [nan]},
        4: {"a": [1e-30], "b": [2e-30], "c": [-1.0]},
        5: {"b": [nan], "a": [None], "c": [-1e17], "d": [-9e16]},
    }
    rows = [(e, c, y) for e, cameras in heard.items() for c, ys in cameras.items() for y in ys]
    want = {1: "abc", 2: "eabcd", 3: "bcad", 4: "bac", 5: "dcab"}
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "e int, c string, y double").coalesce(1)
        assert {r.e: "".join(r.cameras) for r in convert.camera_order(df, ["e"], "c", "y").collect()} == want


def test_bounds_in_single_precision_lose_no_nearest_row():
    rng = np.random.default_rng(12)
    for scale in (1e-6, 1.0, 1e4, 1e13, 1e18):
        a, b = rng.normal(size=(60, 16)), rng.normal(size=(300, 16))
        for x in (a, b):
            x[:, :8] *= scale
            x[:, 8:12] /= np.linalg.norm(x[:, 8:12], axis=1, keepdims=True)
            x[:, 12:] /= np.linalg.norm(x[:, 12:], axis=1, keepdims=True)
        b[:60] = a + rng.normal(size=a.shape) * 1e-9  # nearer than single precision tells
        b[60], b[61, :8], b[62, :8] = np.nan, 1e300, 1e15
        moved = a[:, None] - b[None]
        far = sum(np.sqrt((moved[..., o : o + 3] ** 2).sum(axis=-1)) + 0.2 * np.abs(moved[..., o + 3]) for o in (0, 4))
        d = far + sum(np.arccos(np.minimum(np.abs((a[:, None, o : o + 4] * b[None, :, o : o + 4]).sum(axis=-1)), 1)) for o in (8, 12))
        i, j = joins.near_places(a, b)
        assert set(enumerate(np.nanargmin(d, axis=1).tolist())) <= set(zip(i.tolist(), j.tolist())) and len(i) < 4 * len(a)


def test_bridges_of_a_pair_are_dealt_to_tasks(spark):
    rng = np.random.default_rng(13)
    schema = "pair int, i int, s array<double>, a array<double>"
    losers, winners = (spark.createDataFrame([(0, i, *[[float(x) for x in rng.normal(size=16)] for _ in range(2)]) for i in range(60)], schema) for _ in range(2))
    s = augment.augment_pairs(losers, winners, "pair", "i", "s", "a", horizon=3).where("kind = 'negative'")
    assert s.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() > 4


def test_sample_counts_are_those_of_the_samples(spark):
    rng = np.random.default_rng(11)
    schema = "pair int, i int, s array<double>, a array<double>"
    rows = lambda sizes: spark.createDataFrame([(p, i, *[[float(x) for x in rng.normal(size=16)] for _ in range(2)]) for p, n in sizes.items() for i in range(n)], schema)
    losers, winners = rows({1: 5, 2: 2, 3: 4}), rows({1: 3, 2: 4, 4: 2})
    want = augment.augment_pairs(losers, winners, "pair", "i", "s", "a", horizon=3).groupBy("pair", "kind").count()
    got = augment.sample_counts(losers, winners, "pair", horizon=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "negative", 3), (1, "positive", 3), (2, "positive", 4), (4, "positive", 2)]


def test_rows_of_large_groups_stay_where_they_are(spark):
    data = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("_x"))
    targets = spark.createDataFrame([(0, 10.0, 20.0), (1, 90.0, 95.0)], "g long, lo double, hi double").localCheckpoint()
    some = {few: stats._within(data, targets, ["g"], few) for few in (True, False)}
    assert "BroadcastHashJoin" in some[True]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, some[True].select("g", "_x").collect())) == sorted(map(tuple, some[False].select("g", "_x").collect())) and some[True].count() == 9
