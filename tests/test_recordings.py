"""The recording source: planning, pushed filters, fan-out, containers of either kind, and what is refused."""

import io
import json
import pickle
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import recordings
from kinelake.sources import recordings as source


def demo(path, demos, frames=4):
    arrays = {f"data/demo_{d}/obs/{n}": np.full((frames, w), d, np.float32) for d in range(demos) for n, w in (("ee_pos", 3), ("ee_ori", 3), ("gripper_states", 2))}
    source.write_file(str(path), source.archive(arrays))


def read(spark, path, layout, **options):
    source.register(spark)
    return spark.read.format("recording").option("layout", layout).options(**options).load(str(path))


def test_a_partition_for_each_container_or_for_many(spark, tmp_path):
    for k in range(6):
        demo(tmp_path / f"task_{k}_demo.hdf5", 2)
    assert read(spark, tmp_path, "demo_h5", partitionBytes=1).rdd.getNumPartitions() == 6
    df = read(spark, tmp_path, "demo_h5")
    assert df.rdd.getNumPartitions() == 1
    assert df.groupBy("episode").count().where("count = 4").count() == 12


def test_filters_reach_the_scan(spark, tmp_path):
    for split in ("seen", "unseen"):
        for k in range(3):
            demo(tmp_path / split / f"pick_{split}_{k}_demo.hdf5", 2)
    df = read(spark, tmp_path, "demo_h5", split="seen,unseen", partitionBytes=1)
    some = df.where((F.col("split") == "seen") & F.contains("instruction", F.lit("1")) & (F.col("frame_index") > 1))
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter" in line and "frame_index" in line]
    assert kept and not any("seen" in line or "Contains" in line for line in kept)
    assert some.rdd.getNumPartitions() == 1  # planned containers only
    assert {r.episode for r in some.collect()} == {"pick_seen_1_demo.hdf5::demo_0", "pick_seen_1_demo.hdf5::demo_1"}
    one = df.where(F.col("episode").isin("pick_seen_0_demo.hdf5::demo_1", "no"))
    assert {r.episode for r in one.collect()} == {"pick_seen_0_demo.hdf5::demo_1"}
    assert {r.split for r in read(spark, tmp_path, "demo_h5", split="unseen", tasks="PICK").collect()} == {"unseen"}
    assert read(spark, tmp_path, "demo_h5", tasks="push").count() == 0


def test_reader_decides_while_planning(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    for split in ("success", "failure"):
        source.write_file(str(tmp_path / split / "a" / "trajectory.h5"), source.archive({"x": np.zeros(1)}))
    reader = source.RecordingReader({"layout": "split_h5", "path": str(tmp_path)})
    left = GreaterThan(("frame_index",), 3)
    assert list(reader.pushFilters([EqualTo(("split",), "success"), left, In(("split",), ("success", "failure"))])) == [left]
    assert [p.containers[0][1] for p in reader.partitions()] == ["success"]
    other = source.RecordingReader({"layout": "split_h5", "path": str(tmp_path)})
    list(other.pushFilters([EqualTo(("split",), "failure")]))
    assert other.partitions() == [source.Packed([])]  # success is the default split


def test_files_of_the_root_have_no_split(spark, tmp_path):
    demo(tmp_path / "a_demo.hdf5", 1)
    demo(tmp_path / "seen" / "b_demo.hdf5", 1)
    assert {r.instruction for r in read(spark, tmp_path, "demo_h5", split="seen").collect()} == {"a"}


def test_hdf5_through_its_library(monkeypatch):
    class Dataset:
        def __init__(self, a):
            self.a = a

        def __getitem__(self, _):
            return self.a

    class File(dict):
        def __init__(self, data, mode):
            super().__init__({"g/x": Dataset(np.arange(3))})
            self.attrs = {"task_name": b"wipe"}

        def visititems(self, each):
            for k, v in self.items():
                each(k, v)

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File, Dataset=Dataset))
    tree = source.Tree(b"\x89HDF\r\n")
    assert tree.array("g/x").tolist() == [0, 1, 2] and tree.text("@task_name") == "wipe" and tree.find(["x"]) == "g/x"


def test_hdf5_without_its_library(monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(RuntimeError, match="h5py"):
        source.Tree(b"\x89HDF\r\n")


def test_only_arrays_unpickle():
    good = {"state": np.arange(6.0).reshape(2, 3), "n": 3, "s": np.float32(2)}
    assert source.StepUnpickler(io.BytesIO(pickle.dumps(good))).load()["state"].shape == (2, 3)
    with pytest.raises(pickle.UnpicklingError):
        source.StepUnpickler(io.BytesIO(pickle.dumps(print))).load()


def test_unknown_layout():
    with pytest.raises(ValueError):
        source.RecordingReader({"layout": "tape", "path": "/"})


def test_candidates_in_order():
    tree = source.Tree(source.archive({"old/b": np.zeros(1), "a/b": np.ones(1), "b": np.zeros(2)}))
    assert tree.find(["a/b", "b"]) == "a/b" and tree.find(["b"]) == "b" and tree.find(["c", "old/b"]) == "old/b" and tree.find(["c"]) is None


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert recordings.demo_frames(read(spark, tmp_path, "demo_h5")).collect() == []


@pytest.mark.parametrize("states,actions,series,want", [(5, 4, 5, [1, 2, 3, 4]), (4, 4, 4, [0, 1, 2, 3]), (3, 4, None, [0, 1, 2]), (6, 4, None, [1, 2, 3, 4])])
def test_annotated_lengths(spark, tmp_path, states, actions, series, want):
    held = {"texts": [" t "], "state": [[float(i)] * 3 + [0.0] * 3 + [0.1 * i] for i in range(states)], "action": [[9.0] * 6 + [0.01 * i] for i in range(actions)]}
    if series:
        held["continuous_gripper_state"] = [0.05 * i for i in range(series)]
    source.write_file(str(tmp_path / "annotation" / "train" / "7.json"), json.dumps(held).encode())
    rows = sorted(recordings.annotated_frames(read(spark, tmp_path, "annotated_json")).collect(), key=lambda r: r.frame_index)
    assert [r.action[0] for r in rows] == want and {r.instruction for r in rows} == {"t"}
    longer = states > actions
    grip = [0.05 * (i + longer) if series else 0.1 * (i + 1) if longer else 0.01 * i for i in range(len(rows))]
    assert [r.action[7] for r in rows] == pytest.approx([1 - g for g in grip])


def test_dual_arm_constant_gripper(spark, tmp_path):
    arrays = {f"{f}/robot_{p}_{s}": np.full((3, n), 0.5, np.float32) for f in ("command_poses_dict", "poses_dict") for s in ("left", "right") for p, n in (("arm", 7), ("gripper", 1))}
    source.write_file(str(tmp_path / "pour_water" / "1.hdf5"), source.archive(arrays))
    rows = recordings.dual_arm_frames(read(spark, tmp_path / "pour_water", "dual_arm_h5")).collect()
    assert len(rows) == 3 and {r.instruction for r in rows} == {"pour water"} and all(r.action[7] == 1.0 == r.action[15] for r in rows)


def test_faults_are_rows_where_asked_and_end_the_job_by_default(spark, tmp_path):
    demo(tmp_path / "good" / "a_demo.hdf5", 2)
    demo(tmp_path / "bad" / "b_demo.hdf5", 1)
    whole = (tmp_path / "bad" / "b_demo.hdf5").read_bytes()
    source.write_file(str(tmp_path / "bad" / "c_demo.hdf5"), whole[: len(whole) // 2])
    broken = {"data/demo_0/obs/ee_pos": np.zeros((4, 3)), "data/demo_1/obs/ee_pos": np.array(["x"] * 4), "data/demo_2/obs/ee_pos": np.ones((4, 3))}
    source.write_file(str(tmp_path / "half" / "d_demo.hdf5"), source.archive(broken))
    source.write_file(str(tmp_path / "empty" / "e_demo.hdf5"), b"")
    with pytest.raises(Exception, match="could not convert|zip"):
        read(spark, tmp_path, "demo_h5").collect()
    df = read(spark, tmp_path, "demo_h5", errors="report")
    folder = F.regexp_extract("container", r"(\w+)/[^/]*$", 1)
    rows = {r.dataset: r for r in recordings.conversion_summary(df, folder).collect()}
    assert {k: (r.status, r.episodes, r.frames, r.faults) for k, r in rows.items()} == {"good": ("ok", 2, 8, 0), "bad": ("error", 1, 4, 1), "half": ("error", 2, 8, 1), "empty": ("error", 0, 0, 1)}
    assert rows["good"].error is None and "ValueError" in rows["half"].error
    assert [r.episode for r in df.where("error is not null and episode is not null").collect()] == ["d_demo.hdf5::demo_1"]
    assert df.where("episode = 'a_demo.hdf5::demo_1'").count() == 4  # a fault of other containers is not this episode's
    fine = recordings.conversion_summary(df.where(folder == "good"), folder, strict=True).collect()
    assert [r.status for r in fine] == ["ok"]
    with pytest.raises(Exception, match="half: ValueError"):
        recordings.conversion_summary(df.where(folder == "half"), folder, strict=True).collect()
    assert recordings.conversion_summary(df.where("false"), folder).collect() == []
    with pytest.raises(ValueError):
        source.reports({"errors": "ignore"})
