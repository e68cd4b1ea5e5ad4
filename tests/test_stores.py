import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.plans import bindings
from kinelake.sources import codecs, pairs, repos

from .conftest import SMALL


def test_observations_come_back_and_arrays_are_kept_once():
    image = np.arange(192, dtype=np.uint8).reshape(8, 8, 3)
    observation = {"state": np.zeros(16, np.float32), "nested": {"image": image, "history": np.ones((1, 16), np.float32)}, "frames": [{"image": image}], "step": 3, "flag": np.bool_(True)}
    blobs = {}
    skeleton = json.loads(json.dumps(pairs.split_observation(observation, blobs)))
    assert len(blobs) == 3
    back = pairs.join_observation(skeleton, blobs)
    assert np.array_equal(back["nested"]["image"], image) and np.array_equal(back["frames"][0]["image"], image)
    assert back["state"].dtype == np.float32 and back["step"] == 3 and back["flag"] is True
    with pytest.raises(ValueError):
        pairs.split_observation(np.array([{}], dtype=object), {})


def test_pairs_are_listed_when_complete(spark, tmp_path):
    frame = lambda i: {"ts": 1000.0 + i, "source": "policy", "state": np.zeros(16), "action": np.full(16, i), "observation": {"image": np.zeros((8, 8, 3), np.uint8), "step": i}}
    root = str(tmp_path)
    pairs.write_pair(spark, root, "p1", 3, [frame(0), frame(1)], [frame(2), frame(3)], metadata={"pair_id": "no", "note": "x"})
    pairs.write_pair(spark, root, ".hidden", 3, [frame(0)], [frame(1)])
    listed = pairs.completed_pairs(spark, root).collect()
    assert [(r.pair_id, r.round_id, r.metadata) for r in listed] == [("p1", 3, {"note": "x"})]
    assert pairs.read_blobs(spark, root).count() == 1
    with pytest.raises(ValueError):
        pairs.write_pair(spark, root, "p2", 1, [], [frame(0)])


def test_repositories_are_found_and_read(spark, tmp_path):
    t = bindings.trajectory(spark, SMALL).withColumn("task", F.lit("pick_up")).withColumn("timestamp", F.col("frame_index") / 5.0)
    repos.write_repo(t, f"{tmp_path}/a/repo", 5.0)
    repos.write_repo(t.where("episode < 3"), f"{tmp_path}/b", 5.0)
    (tmp_path / "c/meta/info").mkdir(parents=True)
    assert [r.root.split("/")[-1] for r in repos.find_repos(spark, [str(tmp_path)]).collect()] == ["repo", "b"]
    e = repos.read_episodes(spark, f"{tmp_path}/a/repo", split="1:4", tasks=["PICK"])
    assert [r.episode_index for r in e.collect()] == [1, 2, 3]
    assert repos.read_episodes(spark, f"{tmp_path}/a/repo", tasks=["other"]).count() == 0
    assert repos.read_episodes(spark, f"{tmp_path}/a/repo", start=8).count() == 2
    info = repos.read_json_lines(spark, f"{tmp_path}/a/repo/meta/info", "total_episodes long, total_frames long, fps double").first()
    assert info.total_episodes == 10 and info.total_frames == t.count()


def test_segments_default_to_the_whole_episode(spark):
    df = spark.createDataFrame([(0, 10, "x", []), (1, 10, "y", [(2, 5, "cut", ""), (5, 5, "none", "")])], "episode_index long, length long, instruction string, segments array<struct<start_frame:long,end_frame:long,action_text:string,skill:string>>")
    got = sorted((r.episode_index, r.start_frame, r.end_frame, r.action_text) for r in repos.segments(df).collect())
    assert got == [(0, 0, 10, "x"), (1, 2, 5, "cut")]
    cams = spark.createDataFrame([(0, "main", 8), (0, "wrist", 9), (1, "main", 9)], "episode_index long, camera string, frames long")
    assert [(r.episode_index, r.end_frame) for r in repos.eligible(repos.segments(df), 3, cams, ["main", "wrist"]).collect()] == [(0, 8)]


def test_containers_are_read_by_layout(spark, tmp_path):
    state = np.arange(12.0).reshape(6, 2)
    np.savez(tmp_path / "one.npz", state=state, action=state[:5] + 1, time=np.arange(6) + 10.0, instruction=np.array(["do it "]))
    rows = codecs.read_layout(spark, str(tmp_path), codecs.LAYOUTS["npz"]).orderBy("frame_index").collect()
    assert len(rows) == 5 and rows[0].timestamp == 0.0 and rows[4].timestamp == 4.0 and rows[0].instruction == "do it" and rows[1].action == [3.0, 4.0]
    (tmp_path / "a.json").write_text(json.dumps({"state": state.tolist(), "texts": ["go"]}))
    got = codecs.read_layout(spark, str(tmp_path), codecs.LAYOUTS["annotated_json"]).orderBy("frame_index").collect()
    assert len(got) == 6 and got[0].action == [2.0, 3.0] and got[5].action == [10.0, 11.0] and got[0].timestamp is None


def test_pickles_are_never_loaded(spark, tmp_path):
    np.savez(tmp_path / "bad.npz", state=np.array([{"x": 1}], dtype=object))
    with pytest.raises(Exception, match="allow_pickle|pickle"):
        codecs.read_layout(spark, str(tmp_path), codecs.LAYOUTS["npz"]).collect()


def test_layout_rules():
    arrays = {"a/state": np.arange(6.0).reshape(3, 2), "b/action": np.zeros((3, 2))}
    paired = codecs.frames_of(arrays, codecs.Layout("p", ".x", action="paired"))
    assert len(paired["state"]) == 2 and list(paired["action"][0]) == [2.0, 3.0]
    assert codecs.resolve(["x/state", "state"], ["state"]) == "state" and codecs.resolve(["x/state"], ["qpos", "state"]) == "x/state" and codecs.resolve(["x"], ["y"]) is None
    marked = codecs.frames_of({"observations/qpos": np.zeros((2, 2)), "action": np.zeros((2, 2)), "prompt": np.array(["scene described here: fold"])}, codecs.LAYOUTS["prompted_h5"])
    assert marked["instruction"] == ["fold"] * 2


def test_blobs_split_by_size_and_too_large_sizes_fail(spark):
    df = spark.createDataFrame([(1, bytearray(b"aabbbc"), [2, 3, 1])], "k int, blob binary, sizes array<long>")
    assert [bytes(r.data) for r in codecs.split_blob(df, "blob", "sizes", ["k"]).orderBy("position").collect()] == [b"aa", b"bbb", b"c"]
    with pytest.raises(Exception, match="larger"):
        codecs.split_blob(df.withColumn("sizes", F.array(F.lit(9).cast("long"))), "blob", "sizes", ["k"]).collect()


def test_cameras_checkpoints_manifests(spark, tmp_path):
    cams = spark.createDataFrame([(1, "left"), (1, "main"), (2, "left")], "e int, camera string")
    assert {r.e: r.camera for r in codecs.first_camera(cams, ["e"], ["main", "left"]).collect()} == {1: "main", 2: "left"}
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, modified long")
    assert [r.path for r in repos.stale_checkpoints(files).collect()] == ["a"]
    repos.append_manifest(spark, str(tmp_path / "m"), "augment", 2, "run", ["x"])
    assert spark.read.parquet(str(tmp_path / "m")).first().outputs == ["x"]
    checks = spark.createDataFrame([("a", True, ""), ("b", False, "missing")], "name string, ok boolean, detail string")
    assert tuple(repos.preflight(checks).first()) == (False, ["b"])


def test_cache_reads_through(spark):
    jobs = spark.createDataFrame([(1, 5, "cam_high", 0), (1, 5, "cam_main", 8)], "ratio int, episode_index long, camera string, clip_start long")
    path = repos.cache_key(F.col("ratio"), F.col("episode_index"), F.col("camera"), F.col("clip_start"))
    cached = jobs.limit(1).select(path.alias("path"), F.lit(1.0).alias("value"))
    both, fresh = repos.read_through(jobs, cached, lambda missing: missing.select("path", F.lit(2.0).alias("value")))
    assert sorted(r.value for r in both.collect()) == [1.0, 2.0] and fresh.count() == 1


def test_samples_of_different_shape_are_an_error(spark):
    good = spark.createDataFrame([([[1.0, 2.0]], [[3.0, 4.0]])], "winner array<array<double>>, loser array<array<double>>")
    assert pairs.validate_samples(good).count() == 1
    bad = spark.createDataFrame([([[1.0, 2.0]], [[3.0]])], "winner array<array<double>>, loser array<array<double>>")
    with pytest.raises(Exception, match="shape"):
        pairs.validate_samples(bad).collect()


def test_a_round_of_samples_counts_once_its_manifest_names_it(spark, tmp_path):
    from kinelake.sources import samples

    root = str(tmp_path / "samples")
    chunk = lambda v, n=2: F.array_repeat(F.array(F.lit(float(v)), F.lit(0.0)), n)
    some = lambda n, v: spark.range(n).select(F.col("id").alias("sample"), chunk(v).alias("winner"), chunk(-v).alias("loser"))
    assert samples.write_samples(some(5, 1), root, 1, "a.json") == 5
    assert samples.write_samples(some(3, 2), root, 2, "a.json") == 3
    some(7, 9).write.parquet(f"{root}/samples/folder=left-by-a-lost-writer")
    held = lambda: sorted((r["round"], r.winner[0][0]) for r in samples.read_samples(spark, root).collect())
    assert held() == [(1, 1.0)] * 5 + [(2, 2.0)] * 3
    assert samples.write_samples(some(2, 4), root, 1, "b.json") == 2  # the round is replaced as a whole
    assert held() == [(1, 4.0)] * 2 + [(2, 2.0)] * 3
    assert {(r["round"], r.serial, r.samples, r.config, r.history_action_representation) for r in samples.rounds(spark, root).collect()} == {(1, 2, 2, "b.json", "absolute"), (2, 1, 3, "a.json", "absolute")}
    with pytest.raises(Exception, match="differ in shape"):
        samples.write_samples(some(1, 1).withColumn("loser", chunk(0, 3)), root, 3, "a.json")
    assert {r["round"] for r in samples.rounds(spark, root).collect()} == {1, 2}
    assert samples.write_samples(some(0, 1), root, 4, "a.json") == 0 and len(held()) == 5
    with pytest.raises(ValueError):
        samples.write_samples(some(1, 1), root, 5, "a.json", "relative")
    samples.write_samples(some(1, 7), root, 5, "a.json", "absolute")
    with pytest.raises(Exception, match="representations differ"):
        held()


def test_text_variants_keep_every_raw_text(spark):
    from kinelake.operators import indexing

    rows = spark.createDataFrame([("a  b",), ("a b",), (" a b",), ("a b",), ("",), ("  ",)], "t string")
    got = {(r.normal_text, r.raw_text, r.num_links) for r in indexing.text_variants(rows, "t").collect()}
    assert got == {("a b", "a  b", 1), ("a b", "a b", 2), ("a b", " a b", 1), ("", "", 1), ("", "  ", 1)}
    keys = indexing.text_keys(rows, "t").collect()
    assert sorted((r.raw_texts, r.num_links) for r in keys) == [(2, 2), (3, 4)]
