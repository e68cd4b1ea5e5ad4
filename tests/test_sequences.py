import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import layout, text
from kinelake.operators import align, augment, indexing, mixing, resample, sequence, stats, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def stamp(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_causal_match_never_looks_ahead(spark):
    obs = frame(spark, [(1, stamp(1.0), 0, 0.0), (1, stamp(1.2), 1, 1.0)], "k int, t timestamp, i int, v double")
    act = frame(spark, [(1, stamp(1.1), 9), (2, stamp(1.1), 8), (1, stamp(0.5), 7)], "k int, t timestamp, i int")
    out = {r.i: r for r in align.asof(act, obs, ["k"], "t", "i", ["v"]).collect()}
    assert out[9].r_v == 0.0 and abs((out[9].r_t - out[9].t).total_seconds() + 0.1) < 1e-6
    assert out[8].r_v is None and out[7].r_v is None


def test_nearest_ties_go_to_the_earlier(spark):
    obs = frame(spark, [(1, stamp(1.0), 0), (1, stamp(3.0), 1)], "k int, t timestamp, i int")
    act = frame(spark, [(1, stamp(2.0), 5), (1, stamp(2.5), 6), (1, stamp(9.0), 7), (1, stamp(0.0), 8)], "k int, t timestamp, i int")
    assert {r.i: r.r_i for r in align.asof_nearest(act, obs, ["k"], "t", "i", ["i"]).collect()} == {5: 0, 6: 1, 7: 1, 8: 0}


def test_camera_triplet_stamp_and_skew(spark):
    one = lambda s, i: frame(spark, [(1, stamp(s), i)], "k int, t timestamp, i int")
    out = align.nway_sync([("a", one(100.00, 1)), ("b", one(100.02, 2)), ("c", one(100.04, 3))], ["k"], "t", "i", 0.05).collect()
    assert len(out) == 1 and out[0].stamp == stamp(100.04) and abs(out[0].skew - 0.04) < 1e-6
    assert align.nway_sync([("a", one(100.00, 1)), ("b", one(100.02, 2)), ("c", one(100.06, 3))], ["k"], "t", "i", 0.05).count() == 0


def test_last_64_of_70_steps(spark):
    rows = frame(spark, [(0, i) for i in range(1, 71)], "e int, step int")
    assert sorted(r.step for r in sequence.last_rows(rows, 64, ["e"], ["step"], exact=True).collect()) == list(range(7, 71))
    assert sequence.last_rows(rows, 71, ["e"], ["step"], exact=True).count() == 0


def test_32_actions_are_four_batches(spark):
    out = sequence.batches(frame(spark, [(0, i) for i in range(32)], "e int, i int"), 8, ["e"], ["i"])
    got = sorted((r.batch_id, r.n, r.first_batch, r.last_batch) for r in out.groupBy("batch_id", "first_batch", "last_batch").agg(F.count("*").alias("n")).collect())
    assert got == [(0, 8, True, False), (1, 8, False, False), (2, 8, False, False), (3, 8, False, True)]


def test_waypoint_times(spark):
    rows = frame(spark, [(b, i, 0.6 if b == 0 and i == 0 else 0.1) for b in range(4) for i in range(8)], "b int, i int, d double")
    out = {(r.b, r.i): round(r.arrives_at, 9) for r in sequence.schedule(rows, "d", ["b"], ["i"]).collect()}
    assert [out[0, i] for i in range(8)] == [0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3]
    assert [out[3, i] for i in range(8)] == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@pytest.mark.parametrize("size,shares,want", [(100, mixing.FIRST_ROUND, [80, 20]), (100, mixing.LATER_ROUNDS, [70, 15, 15]), (32, mixing.LATER_ROUNDS, [22, 5, 5]), (10, mixing.LATER_ROUNDS, [7, 2, 1]), (4, mixing.LATER_ROUNDS, [3, 1, 0])])
def test_quotas(spark, size, shares, want):
    out = {r.source: r.quota for r in mixing.quotas(frame(spark, [(size,)], "size long"), "size", shares).collect()}
    assert [out[s] for s, _ in shares] == want


def test_mixed_batch_has_its_quotas_and_needs_its_sources(spark):
    sources = {n: spark.range(k * 1000, k * 1000 + 50).select(F.col("id").alias("doc")) for k, n in enumerate(("current", "history", "sft"))}
    rows = mixing.mixed_batch(spark, sources, 40, mixing.LATER_ROUNDS, ["doc"], 1).collect()
    assert sorted(r.position for r in rows) == list(range(40))
    assert {s: sum(r.source == s for r in rows) for s in sources} == {"current": 28, "history": 6, "sft": 6}
    with pytest.raises(Exception, match="empty"):
        mixing.mixed_batch(spark, sources | {"sft": sources["sft"].limit(0)}, 40, mixing.LATER_ROUNDS, ["doc"], 1).collect()


def test_random_numbers_are_dense_and_do_not_depend_on_partitions(spark):
    one = {r.id: r.number for r in mixing.numbered(spark.range(500), ["id"], 3).collect()}
    two = {r.id: r.number for r in mixing.numbered(spark.range(500).repartition(7), ["id"], 3).collect()}
    assert one == two and sorted(one.values()) == list(range(500))


def test_augmentation_counts(spark):
    zero = lambda x: [x, 0, 0, 1, 0, 0, 0, 0] + [0, 0, 0, 1, 0, 0, 0, 0]
    side = lambda xs: frame(spark, [("p", i, [float(v) for v in zero(x)], [float(v) for v in zero(0.01)]) for i, x in enumerate(xs)], "pair string, i int, s array<double>, a array<double>")
    rows = augment.augment_pairs(side([0, 0.1, 0.2]), side([0, 0.05, 0.1, 0.15]), "pair", "i", "s", "a", horizon=3).collect()
    kinds = [r.kind for r in rows]
    assert len(rows) == 5 and kinds.count("negative") == 1 and kinds.count("positive") == 4
    assert all(len(r.winner) == len(r.loser) == 3 for r in rows)
    assert all(r.winner == r.loser for r in rows if r.kind == "positive")


def test_preference_loss_is_finite_and_as_written(spark):
    df = frame(spark, [(1.0, 2.0, 1.5, 1.5), (2.0, 1.0, 1.5, 1.5)], "cw double, cl double, rw double, rl double")
    got = stats.preference_loss(df, "cw", "cl", "rw", "rl").first()
    ls = lambda x: -np.log1p(np.exp(-x))
    a, b = 0.5 * (1.5 - np.array([1.0, 2.0])), 0.5 * (1.5 - np.array([2.0, 1.0]))
    pro = np.mean(-ls(a - b) - 0.5 * (ls(a) + ls(-a) + ls(b) + ls(-b)))
    assert np.isclose(got.loss_pro, pro) and np.isclose(got.loss_sft, 1.5) and np.isclose(got.loss, pro + 1.5)


def test_interpolation_like_numpy(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 10, 30))
    v = rng.normal(size=30)
    samples = frame(spark, [(1, float(a), float(b)) for a, b in zip(t, v)], "k int, t double, v double")
    grid = frame(spark, [(1, i, float(x)) for i, x in enumerate(np.linspace(-1, 11, 100))], "k int, frame_index int, grid_time double")
    got = resample.interpolate(grid, samples, ["k"], "t", "v", "y").orderBy("frame_index").collect()
    assert np.allclose([r.y for r in got], np.interp(np.linspace(-1, 11, 100), t, v))
    single = resample.interpolate(grid, samples.limit(1), ["k"], "t", "v", "y").select("y").distinct().count()
    assert single == 1


def test_series_keep_the_first_of_equal_times(spark):
    rows = [(1, 0, 1.0, 5.0), (1, 1, 1.0, 6.0), (1, 2, float("nan"), 7.0), (1, 3, 2.0, float("inf")), (1, 4, 3.0, None), (1, 5, 2.5, 8.0)]
    out = resample.prepare_series(frame(spark, rows, "k int, i int, t double, v double"), ["k"], "t", "i", ["v"]).collect()
    assert sorted((r.t, r.v) for r in out) == [(1.0, 5.0), (2.5, 8.0)]


def test_grid_length(spark):
    w = frame(spark, [(1, 0.0, 1.0), (2, 0.0, 0.05), (3, 2.0, 2.0)], "k int, s double, e double")
    out = resample.uniform_grid(w, "s", "e", 10.0).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in out} == {1: 11, 2: 1}


def numpy_keyframes(n, intervals, every):
    keep = np.zeros(n, bool)
    for a, b in intervals:
        keep[a : b + 1] = True
    cursor = 0
    for a, b in [*intervals, (n, n - 1)]:
        keep[np.arange(cursor, max(cursor, a), every)] = True
        cursor = max(cursor, b + 1)
    keep[[0, -1]] = True
    return np.flatnonzero(keep).tolist()


@pytest.mark.parametrize("intervals", [[], [(0, 3)], [(5, 9), (20, 22)], [(3, 3), (4, 8), (29, 29)]])
def test_keyframes_against_a_loop(spark, intervals):
    frames = frame(spark, [(0, i) for i in range(30)], "e int, i long")
    iv = frame(spark, [(0, a, b) for a, b in intervals], "e int, start long, end long")
    got = sorted(r.i for r in windows.keyframes(frames, iv, 4, ["e"], "i").collect())
    assert got == numpy_keyframes(30, intervals, 4)


def test_history_is_in_phase_and_padded(spark):
    rows = frame(spark, [(0, i) for i in range(20)], "e int, i long")
    out = {r.i: r for r in windows.strided_history(rows, "i", "i", 3, 4, ["e"], F.lit(-1).cast("long")).collect()}
    assert out[0].history == [-1] * 4 and out[0].history_mask == [False] * 4
    assert out[7].history == [-1, -1, 1, 4] and out[7].history_mask == [False, False, True, True]
    assert out[19].history == [7, 10, 13, 16]


def test_window_sizes_and_segments_that_are_too_short(spark):
    assert windows.raw_window(1) == 33 and windows.raw_window(2) == 65
    seg = frame(spark, [(1, 0, 65), (2, 0, 64), (3, 5, 5)], "e int, s long, t long")
    assert [(r.e, r.clip_start) for r in windows.clip_plan(seg, "s", "t", [2]).collect()] == [(1, 0)]


def test_rate_gate_depends_on_what_passed(spark):
    rows = frame(spark, [(1, i, t) for i, t in enumerate([0.0, 0.6, 1.0, 1.7, 2.1, 2.2])], "k int, i int, t double")
    assert [r.t for r in sequence.rate_gate(rows, "t", 1.0, ["k"], ["i"]).orderBy("t").collect()] == [0.0, 1.0, 2.1]


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("g"), F.col("id").alias("i"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("task"))
    a = indexing.global_index(df, "g", ["i"]).select("i", "index").collect()
    b = indexing.global_index(df.repartition(9), "g", ["i"]).select("i", "index").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and sorted(r["index"] for r in a) == list(range(300))
    assert {r.task: r.n for r in indexing.first_appearance_ids(df.repartition(5), "task", ["i"], "n").collect()} == {f"t{k}": k for k in range(5)}


def test_natural_order(spark):
    names = ["ep10", "ep9", "ep010b", "Ep1", "x", "2", "10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(indexing.natural_key(F.col("n")), "n").collect()] == ["2", "10", "Ep1", "ep9", "ep10", "ep010b", "x"]


def test_text_functions(spark):
    df = spark.createDataFrame([("30/1", "described here: pick up", "a_b-c", None), ("0/0", "plain ", "x", ""), ("29.97", None, "y__z", "T")], "r string, m string, n string, f string")
    rows = df.select(text.rate(F.col("r")).alias("r"), text.after_marker(F.col("m"), "described here:").alias("m"), text.words_of_name(F.col("n")).alias("n"), text.first_text(F.col("f"), F.col("n")).alias("f"), text.matches_any(F.col("f"), ["t"]).alias("t")).collect()
    assert [r.r for r in rows] == [30.0, None, 29.97]
    assert [r.m for r in rows] == ["pick up", "plain", None]
    assert [r.n for r in rows] == ["a b c", "x", "y z"] and [r.f for r in rows] == ["a_b-c", "x", "T"]
    assert [r.t for r in rows] == [False, False, True]


def test_depth_rounds_half_to_even_and_saturates(spark):
    df = spark.createDataFrame([(x,) for x in (0.0005, 0.0015, float("nan"), float("inf"), 100.0, -1.0, None)], "d double")
    assert [r.x for r in df.select(text.quantised_depth(F.col("d")).alias("x")).collect()] == [0, 2, 0, 65535, 65535, 0, 0]


def test_grid_ids_and_steps(spark):
    row = spark.range(1).select(layout.grid_ids(2, 2, 3).alias("g"), windows.uniform_step(F.array(*map(F.lit, (1, 3, 5)))).alias("a"), windows.uniform_step(F.array(*map(F.lit, (1, 3, 4)))).alias("b")).first()
    assert len(row.g) == 12 and tuple(row.g[5]) == (0, 1, 2) and row.a == 2 and row.b is None


def test_no_cartesian_and_no_python_in_alignment_plans(spark):
    from kinelake.plans import registry

    from .conftest import SMALL

    for name in ("asof_causal", "asof_nearest", "interp_linear", "pose_delta_encode", "quantile_norm", "batch_quota", "clip_plan"):
        plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    from kinelake.plans import registry

    from .conftest import SMALL

    plan = registry.queries()["asof_causal"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan and "props" not in plan


def test_frames_only_grow(spark):
    """No window looks at all that follows, which would be computed anew for each row."""
    s = spark.createDataFrame([(1, float(i), float(i)) for i in range(5)], "k long, t double, v double")
    grid = s.select("k", F.col("t").cast("long").alias("frame_index"), (F.col("t") + 0.5).alias("grid_time"))
    frames = [resample.interpolate(grid, s, ["k"], "t", "v", "y"), sequence.next_marked(s.withColumn("m", F.col("t") == 3), "m", "v", ["k"], ["t"], "n")]
    for df in frames:
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower().replace(" ", "")


def test_folds_of_many_stretches(spark):
    n = 3 * sequence.STRETCH + 1
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    out = sequence.fold(rows, ["k"], ["i"], ["v"], F.lit(0.0), lambda s, r: s + r["v"], "total")
    total, want = 0.0, []
    for i in range(n):
        total += i % 7
        want.append((i, total))
    assert [(r.i, r.total) for r in out.orderBy("i").collect()] == want


def test_repeated_requests_are_all_answered(spark):
    requests = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 5), (2, 5)], "k long, want long")
    files = spark.createDataFrame([(1, 10), (1, 20)], "k long, file_end long")
    got = sorted(map(str, align.resolve_ranges(requests, files, ["k"], "want", "file_end", []).select("k", "file_end").collect()))
    assert got == sorted(map(str, spark.createDataFrame([(1, 10), (1, 10), (1, 20), (2, None), (2, None)], "k long, file_end long").collect()))


def test_stretches_number_whole_orders(spark):
    rows = [(f"g{k % 900:03d}", k) for k in range(2000)] + [("g000", 5000)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(6)
    place = {r: k for k, r in enumerate(sorted(rows))}
    assert {(r.g, r.i): r["index"] for r in indexing.global_index(df, "g", ["i"]).collect()} == place
    assert {r.g: r.n for r in indexing.renumber(df, "g", "n").select("g", "n").distinct().collect()} == {f"g{k:03d}": k for k in range(900)}
    assert indexing.renumber(df.limit(0), "g", "n").collect() == []
