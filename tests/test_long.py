"""Series that go over many tasks give what one task gives; exact quantiles by refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.operators import align, indexing, resample, sequence, stats


def frame(spark, rng, n, keys=(1, 2, None), times=50):
    rows = [(keys[rng.integers(len(keys))], float(rng.integers(times)), int(i), float(rng.integers(100))) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t double, i long, v double")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_stretches_follow_the_order(spark, ranges, monkeypatch):
    monkeypatch.setattr(indexing, "FANOUT", 8)
    df = frame(spark, np.random.default_rng(ranges), 600, times=400)
    got = [(r._b, (r.k is not None, r.k or 0), r.t) for r in indexing.in_order(df, ["k", "t"], ranges).collect()]
    assert sorted(got) == sorted(got, key=lambda r: (r[1], r[2], r[0]))  # never back
    assert len({(b, k, t) for b, k, t in got}) == len({(k, t) for _, k, t in got})  # one key, one stretch
    assert ranges == 1 or len({b for b, _, _ in got}) > ranges // 3


def test_running_sums(spark):
    df = frame(spark, np.random.default_rng(5), 500)
    got = {r.i: r.s for r in indexing.running(df, ["t", "i"], F.col("v").cast("long"), "s").collect()}
    total = 0
    for r in sorted(df.collect(), key=lambda r: (r.t, r.i)):
        assert got[r.i] == total
        total += int(r.v)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_in_slices(spark, direction):
    rng = np.random.default_rng(1)
    left, right = frame(spark, rng, 200), frame(spark, rng, 60)
    one = align.asof(left, right, ["k"], "t", "i", ["i", "v"], direction)
    for slices in (None, 1, 9, 40):
        assert rows(align.asof(left, right, ["k"], "t", "i", ["i", "v"], direction, slices=slices)) == rows(one)


def test_nearest_sync_and_grids_in_slices(spark):
    rng = np.random.default_rng(2)
    a, b, c = (frame(spark, rng, n) for n in (90, 50, 40))
    near = lambda s: align.asof_nearest(a, b, ["k"], "t", "i", ["i"], slices=s)
    assert rows(near(11)) == rows(near(0))
    sync = lambda s: align.nway_sync([("a", a), ("b", b), ("c", c)], ["k"], "t", "i", 2.0, s)
    assert rows(sync(11)) == rows(sync(0))
    grid = a.select("k", F.col("i").alias("frame_index"), (F.col("t") + 0.25).alias("grid_time"))
    samples = resample.prepare_series(b, ["k"], "t", "i", ["v"])
    fill = lambda s: resample.interpolate(grid, samples, ["k"], "t", "v", "out", slices=s)
    assert rows(fill(13)) == rows(fill(0))
    index = lambda s: resample.nearest_index(grid, samples.withColumn("j", F.col("i")), ["k"], "t", "j", "out", slices=s)
    assert rows(index(13)) == rows(index(0))


def test_one_key_is_shared_by_tasks(spark):
    rng = np.random.default_rng(3)
    left, right = frame(spark, rng, 4000, (1,), 3000), frame(spark, rng, 4000, (1,), 3000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda s: align.asof(left, right, ["k"], "t", "i", ["i"], slices=s).groupBy(F.spark_partition_id()).agg(F.count("r_i").alias("n")).where("n > 0").collect()
        assert len(tasks(0)) == 1
        assert len(tasks(None)) == 4 and max(r.n for r in tasks(64)) < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_is_the_fold(spark, monkeypatch):
    monkeypatch.setattr(sequence, "STRETCH", 5)
    rng = np.random.default_rng(4)
    data = [(k, int(i), [float(x) for x in rng.normal(size=16)]) for k, n in ((1, 240), (2, 1), (3, 6)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, i long, a array<double>")
    one = {(r.k, r.i): r.decoded for r in sequence.decode_deltas(df, "a", ["k"], ["i"], []).collect()}
    for ranges in (1, 20):
        got = {(r.k, r.i): r.decoded for r in sequence.decode_long(df, "a", ["k"], ["i"], [], ranges).collect()}
        assert got.keys() == one.keys() and all(np.allclose(got[x], one[x], atol=1e-9) for x in one)


def test_scan_of_texts(spark, monkeypatch):
    """Not commutative: the order is the rows' own."""
    monkeypatch.setattr(sequence, "STRETCH", 3)
    df = spark.createDataFrame([(k, i, chr(97 + i % 26)) for k in (1, 2) for i in range(40 * k)], "k long, i long, c string")
    got = {(r.k, r.i): r.s for r in sequence.scan(df, ["k"], ["i"], [], F.col("c"), F.concat, "s", 9).collect()}
    assert all(s == "".join(chr(97 + j % 26) for j in range(i + 1)) for (k, i), s in got.items()) and len(got) == 120


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    series = {"normal": rng.normal(size=4000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.array([5.0]), "same": np.full(2000, -1.5), "heavy": np.exp(rng.normal(size=3000) * 20), "small": rng.normal(size=7), "negative": -np.arange(2500.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in series.items() for x in v] + [("normal", None)], "k string, x double")
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    for held in (20, 600):
        got = {(r.k, r.share): r.value for r in stats.exact_quantiles(df, ["k"], "x", shares, held).collect()}
        assert len(got) == len(series) * len(shares)
        for (k, p), value in got.items():
            assert value == pytest.approx(np.quantile(series[k], p), rel=1e-12, abs=1e-12), (k, p)


def test_channel_stats_either_way(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(int(i % 2), [float(x) for x in rng.normal(size=3)]) for i in range(900)], "g long, a array<double>")
    for by in ((), ("g",)):
        few, many = (sorted(stats.channel_stats(df, "a", by, held).collect(), key=lambda r: tuple(r[c] for c in (*by, "channel"))) for held in (1000, 100))
        for a, b in zip(few, many, strict=True):
            assert a.asDict().keys() == b.asDict().keys() and all(a[c] == pytest.approx(b[c], abs=1e-9) for c in a.asDict())


def test_poses_compose_associatively(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([([float(x) for x in rng.normal(size=16)],) * 1 + ([float(x) for x in rng.normal(size=16)], [float(x) for x in rng.normal(size=16)]) for _ in range(50)], "a array<double>, b array<double>, c array<double>")
    start = F.array(*[F.lit(float(x)) for x in [0.0, 0.0, 0.0, *pose.IDENTITY, 0.0] * 2])
    a = pose.apply16(start, F.col("a"))
    left = pose.apply16(pose.apply16(a, F.col("b")), F.col("c"))
    right = pose.apply16(a, pose.apply16(pose.apply16(start, F.col("b")), F.col("c")))
    for r in df.select(left.alias("l"), right.alias("r")).collect():
        assert np.allclose(r.l, r.r, atol=1e-9)
