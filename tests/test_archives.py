"""Recorded pairs of each version, raw frames and their resizing, masks as ranges, draws that any engine repeats."""

import hashlib
import io
import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import joins, mixing
from kinelake.plans.store_queries import archived
from kinelake.sources import frames, legacy, pairs, recordings


def load(spark, path):
    legacy.register(spark)
    return spark.read.format("recorded_pairs").load(str(path))


def test_versions_restore_the_same_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    state, action = rng.normal(size=(5, 16)), rng.normal(size=(5, 16))
    for k in range(3):
        for name, data in archived(k, state, action).items():
            recordings.write_file(str(tmp_path / name), data)
    rows = load(spark, tmp_path).collect()
    assert {(r.pair_id, r.version) for r in rows} == {("pair-0", "stream"), ("pair-1", "split"), ("pair-2", "inline")}
    plain = lambda r: (r.side, r.frame_index, r.ts, r.source, r.action, r.skeleton, {k: (a["dtype"], a["shape"], a["values"]) for k, a in r.arrays.items()})
    own = [sorted((plain(r) for r in rows if r.pair_id == f"pair-{k}"), key=lambda x: x[:2]) for k in range(3)]
    assert own[0] == own[1] == own[2] and len(own[0]) == 5
    assert own[0][0][6]["images/head"] == ("|u1", [2, 2], [0.0] * 4) and own[0][0][6]["state16"][0] == "<f4"
    assert {r.round_id for r in rows if r.pair_id == "pair-0"} == {1}  # a missing round is the first


def test_pushed_pair_and_refused_pickles(spark, tmp_path):
    state = np.zeros((3, 16))
    for name, data in archived(1, state, state).items():
        recordings.write_file(str(tmp_path / name), data)
    out = io.BytesIO()
    np.savez(out, actions=np.array([{"a": 1}], dtype=object), timestamps=np.zeros(1), sources=np.array(["x"]))
    for side in ("loser", "winner"):
        recordings.write_file(str(tmp_path / "bad" / f"{side}.npz"), out.getvalue())
        recordings.write_file(str(tmp_path / "bad" / f"{side}_observations.jsonl"), b"{}\n")
    recordings.write_file(str(tmp_path / "bad" / "metadata.json"), json.dumps({"pair_id": "bad", "rollback_index": 0}).encode())
    good = load(spark, tmp_path).where("pair_id = 'pair-1'")
    assert good.count() == 3  # the other pair's arrays are not opened
    with pytest.raises(Exception, match="allow_pickle"):
        load(spark, tmp_path).collect()


def plain_bilinear(img, h, w):
    out = np.zeros((h, w, img.shape[2]))
    for i in range(h):
        for j in range(w):
            y, x = max((i + 0.5) * img.shape[0] / h - 0.5, 0), max((j + 0.5) * img.shape[1] / w - 0.5, 0)
            y0, x0 = int(y), int(x)
            y1, x1 = min(y0 + 1, img.shape[0] - 1), min(x0 + 1, img.shape[1] - 1)
            v, u = y - y0, x - x0
            out[i, j] = (img[y0, x0] * (1 - u) + img[y0, x1] * u) * (1 - v) + (img[y1, x0] * (1 - u) + img[y1, x1] * u) * v
    return out


@pytest.mark.parametrize("old,new", [((5, 7), (3, 4)), ((4, 4), (9, 2)), ((1, 1), (3, 3)), ((6, 5), (6, 5))])
def test_bilinear(old, new):
    block = np.random.default_rng(2).integers(0, 255, (3, *old, 3)).astype(float)
    got = frames.bilinear(block, *new)
    assert np.allclose(got, np.stack([plain_bilinear(f, *new) for f in block]))


def test_selected_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK", 4)
    rng = np.random.default_rng(3)
    color = rng.integers(0, 255, (11, 2, 3, 3)).astype(np.uint8)
    gray = rng.integers(0, 255, (6, 4, 4, 1)).astype(np.uint8)
    a, b = str(tmp_path / "a.y4m"), str(tmp_path / "b.y4m")
    recordings.write_file(a, frames.y4m(color))
    recordings.write_file(b, frames.y4m(gray))
    recordings.write_file(b + ".npz", recordings.archive({"frames": gray[..., 0] + np.uint8(1)}))
    wanted = spark.createDataFrame([(a, 10), (a, 0), (a, 0), (b, 5), (a, 7)], "path string, frame_index long")
    got = {(r.path, r.frame_index): r for r in frames.selected(wanted).collect()}
    assert got.keys() == {(a, 10), (a, 0), (a, 7), (b, 5)}
    assert got[a, 10].pixels == color[10].reshape(-1).tolist() and (got[a, 7].height, got[a, 7].width, got[a, 7].channels) == (2, 3, 3)
    assert got[b, 5].pixels == (gray[5].reshape(-1) + np.uint8(1)).tolist()  # the sidecar counts first
    small = {(r.path, r.frame_index): r.pixels for r in frames.selected(wanted, (3, 2)).collect()}
    assert np.allclose(small[a, 7], plain_bilinear(color[7].astype(float), 3, 2).reshape(-1), atol=1e-4)
    with pytest.raises(Exception, match="frame 11 of 11"):
        frames.selected(spark.createDataFrame([(a, 11)], "path string, frame_index long")).collect()


@pytest.mark.parametrize("head", [b"RIFFxxxx", b"YUV4MPEG2 W2 H2 C420\n"])
def test_other_videos_are_refused(tmp_path, head):
    from pyarrow import fs

    recordings.write_file(str(tmp_path / "v.y4m"), head)
    with pytest.raises(ValueError):
        frames.Video(fs.LocalFileSystem(), str(tmp_path / "v.y4m"))


def test_visibility_ranges_are_few(spark):
    rng = np.random.default_rng(4)
    rows, token = [], 0
    for seq in (0, 1, -1):
        for _ in range(12):
            kind = (seq, int(rng.integers(-1, 3)), int(rng.integers(2)), int(rng.integers(2)))
            for _ in range(int(rng.integers(1, 9))):
                rows.append((token, *kind))
                token += 1
    tokens = spark.createDataFrame(rows, "token long, seq int, frame int, modality int, noise int")
    blocks = joins.visibility_blocks(tokens)
    pairs_ = sorted(map(tuple, joins.token_visibility(tokens).select("q", "k").collect()))
    assert sorted(map(tuple, joins.expanded(blocks).collect())) == pairs_
    assert blocks.count() <= 3 * 12 * 12 < len(pairs_)
    holes = tokens.where("token % 3 <> 1")
    assert sorted(map(tuple, joins.expanded(joins.visibility_blocks(holes)).collect())) == sorted(map(tuple, joins.token_visibility(holes).select("q", "k").collect()))


def test_draws_are_md5(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    want = {k: int(hashlib.md5(f"9:{k}".encode()).hexdigest()[:8], 16) for k in range(200)}
    assert {r.k: r.d for r in df.select("k", mixing.drawn(9, "k").alias("d")).collect()} == want
    order = sorted(range(200), key=lambda k: (want[k], k))
    assert {r.k: r.number for r in mixing.numbered(df, ["k"], 9).collect()} == {k: i for i, k in enumerate(order)}


def test_pairs_written_at_once(spark, tmp_path):
    rows = [(f"p{k}", side, i, 0.1 * i, "policy", [float(k)] * 16, [1.0] * 16, {"seen": [1.0, float(i)]}) for k in range(3) for side in (("loser", "winner") if k else ("loser",)) for i in range(2)]
    df = spark.createDataFrame(rows, "pair_id string, side string, frame_index int, ts double, source string, state array<double>, action array<double>, observation map<string,array<double>>")
    pairs.write_pairs(df, df.groupBy("pair_id").agg(F.lit(2).alias("round_id")), str(tmp_path))
    assert [r.pair_id for r in pairs.completed_pairs(spark, str(tmp_path)).collect()] == ["p1", "p2"]
    blobs = {r.digest: (r.digest, r.dtype, r.shape, r.data) for r in pairs.read_blobs(spark, str(tmp_path)).collect()}
    assert len(blobs) == 2  # equal arrays are one blob
    row = spark.read.schema(pairs.FRAMES).parquet(f"{tmp_path}/pair_frames").where("pair_id = 'p2' and side = 'winner' and frame_index = 1").first()
    assert pairs.join_observation(json.loads(row.skeleton), blobs)["seen"].tolist() == [1.0, 1.0]


def test_step_lists(tmp_path):
    parts = {"obs": pickle.dumps([{"state": np.ones(2)}, {"state": np.zeros(2), "extra": 1}]), "policy": pickle.dumps({"actions": np.ones((2, 7))})}
    tree = recordings.StepTree(parts)
    assert tree.array("obs/state").shape == (2, 2) and tree.array("policy/actions").shape == (2, 7)
