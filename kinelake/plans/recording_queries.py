"""Recordings of every layout: containers that executors write from the trajectories, read by the ``recording`` source."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import recordings
from kinelake.sources import recordings as source

from .bindings import TRAJ, rounded, sql_unit, trajectory
from .source_queries import workspace

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def written(spark: SparkSession, sf_dir: str, each: Callable[[int, np.ndarray, np.ndarray], dict[str, bytes]]) -> str:
    """A folder with the files that ``each(episode, states, actions)`` makes of every episode; executors write them."""
    root = workspace(spark)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index")
        files = each(int(rows["episode"].iloc[0]), np.stack(rows["state"]).astype(np.float32), np.stack(rows["action"]).astype(np.float32))
        for name, data in files.items():
            source.write_file(f"{root}/{name}", data)
        return pd.DataFrame({"files": [len(files)]})

    trajectory(spark, sf_dir).groupBy("episode").applyInPandas(run, "files long").agg(F.sum("files")).collect()
    return root


def read(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    source.register(spark)
    return spark.read.format("recording").option("layout", layout).options(**options).load(path)


def told(df: DataFrame, episode) -> DataFrame:
    """Episode number, instruction and frame; state and action as one number each, their channels weighed by place."""
    weighed = lambda c: rounded(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4)
    return df.select(episode.alias("episode"), "instruction", "frame_index", weighed("state").alias("s"), weighed("action").alias("a"))


def number(pattern: str):
    return F.regexp_extract("episode", pattern, 1).cast("long")


def sql_told(ctes: str, where: str = "true", text: str = "''", episode: str = "episode") -> str:
    """DuckDB: rows of ``told`` from a relation r (episode, frame_index, s, a) of lists."""
    weigh = lambda v: f"round(list_sum(list_transform({v}, lambda x, i: x * i)), 4) + 0.0"
    return f"with {TRAJ.replace('::double[]', '::float[]::double[]')}, {ctes} select {episode} as episode, {text} as instruction, frame_index, {weigh('s')} as s, {weigh('a')} as a from r where {where}"


W = "over (partition by episode order by frame_index)"
CLIP = lambda x: f"least(greatest({x}, 0.0), 1.0)"
RANGED = lambda x, flat: f"case when max({x}) over (partition by episode) - min({x}) over (partition by episode) < 1e-8 then {flat} else ({x} - min({x}) over (partition by episode)) / (max({x}) over (partition by episode) - min({x}) over (partition by episode)) end"
ROTVEC = lambda v: f"(case when sqrt(list_dot_product({v}, {v})) <= 1e-8 then [1.0, 0.0, 0.0, 0.0]::double[] else list_concat([cos(sqrt(list_dot_product({v}, {v})) / 2)], list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})) * sin(sqrt(list_dot_product({v}, {v})) / 2))) end)"


def EULER(v: str) -> str:
    c, s = ([f"{f}(({v})[{i}] / 2)" for i in (1, 2, 3)] for f in ("cos", "sin"))
    return sql_unit(f"[{c[0]} * {c[1]} * {c[2]} + {s[0]} * {s[1]} * {s[2]}, {s[0]} * {c[1]} * {c[2]} - {c[0]} * {s[1]} * {s[2]}, {c[0]} * {s[1]} * {c[2]} + {s[0]} * {c[1]} * {s[2]}, {c[0]} * {c[1]} * {s[2]} - {s[0]} * {s[1]} * {c[2]}]")


@query(sql_told(f"""r as (select episode, frame_index, list_concat(list_concat(state[1:3], {ROTVEC('state[4:6]')}), [1 - {CLIP('state[7]')}]) as s,
    list_concat(list_concat(action[1:3], {ROTVEC('action[4:6]')}), [1 - {CLIP('action[7]')}]) as a, count(*) over (partition by episode) as n from traj)""", "episode % 3 <> 1 and frame_index < n - 1", "'task ' || (episode % 2)"))
def recording_split(spark, sf_dir):
    """Split containers: success by default, keys by candidates, cut to the shortest array (the last action is missing)."""

    def each(k, state, action):
        arrays = {"observation/robot_state/cartesian_position": state[:, :6], "robot_state/gripper_position": state[:, 6], "action/target_cartesian_position": action[:-1, :6], "old/gripper_velocity": action[:, 6]}
        folder = f"{'failure' if k % 3 == 1 else 'success'}/day/run-{k}"
        return {f"{folder}/trajectory.h5": source.archive(arrays), f"{folder}/metadata_{k}.json": json.dumps({"current_task": f"task {k % 2}"}).encode()}

    return told(recordings.split_frames(read(spark, written(spark, sf_dir, each), "split_h5")), number(r"run-(\d+)$"))


@query(sql_told(f"""h as (select *, list_concat(list_concat(state[1:3], {EULER('state[4:6]')}), [case when state[7] > 0 then 1.0 else 0.0 end]) as s from traj),
    d as (select episode, frame_index % 2 as demo, frame_index // 2 as frame_index, s from h), r as (select episode * 2 + demo as episode, frame_index, s, coalesce(lead(s) over (partition by episode, demo order by frame_index), s) as a, episode as task from d)""", "contains('pick up ' || task, '1')", "'pick up ' || task"))
def recording_demos(spark, sf_dir):
    """Containers with two demos each fan out to episodes; the task filter is pushed into the scan; actions are next states."""

    def each(k, state, action):
        arrays = {f"data/demo_{d}/obs/{name}": part[d::2] for d in (0, 1) for name, part in (("ee_pos", state[:, :3]), ("ee_ori", state[:, 3:6]), ("gripper_states", state[:, 6:8]))}
        return {f"suite/pick_up_{k}_demo.hdf5": source.archive(arrays)}

    rows = read(spark, written(spark, sf_dir, each), "demo_h5").where(F.contains("instruction", F.lit("1")))
    return told(recordings.demo_frames(rows), number(r"pick_up_(\d+)_") * 2 + number(r"demo_(\d+)$"))


def _arms(left: str, right: str) -> str:
    return f"list_concat(list_concat(list_concat(list_concat(list_concat(state[1:3], {left}), [gl]), state[9:11]), {right}), [gr])"


@query(sql_told(f"""g as (select *, {RANGED('state[8]', CLIP('state[8]'))} as gl, {RANGED('state[16]', CLIP('state[16]'))} as gr, {sql_unit('state[4:7]')} as ql, {sql_unit('state[12:15]')} as qr from traj where episode % 2 = 0),
    p as (select *, coalesce(list_dot_product(ql, lag(ql) {W}), 0.0) as dl, coalesce(list_dot_product(qr, lag(qr) {W}), 0.0) as dr from g),
    z as (select *, sum((dl = 0)::int) {W} as il, sum((dr = 0)::int) {W} as ir from p),
    f as (select *, case when sum((dl < 0)::int) over (partition by episode, il order by frame_index) % 2 = 1 then -1.0 else 1.0 end as kl, case when sum((dr < 0)::int) over (partition by episode, ir order by frame_index) % 2 = 1 then -1.0 else 1.0 end as kr from z),
    t as (select episode, frame_index, {_arms('list_transform(ql, lambda x: x * kl)', 'list_transform(qr, lambda x: x * kr)')} as s from f),
    n as (select *, lead(s) {W} as a from t), r as (select * from n where a is not null union all select episode, frame_index, state, action from traj where episode % 2 = 1)""", "true", "'fold cloth'"))
def recording_merged(spark, sf_dir):
    """Two container layouts in one folder: end-effector poses, each state paired with the next, and ready-made states and actions."""

    def each(k, state, action):
        if k % 2:
            arrays = {"observations/qpos": state, "action": action}
        else:
            arrays = {"endpose/left_endpose": state[:, :7], "endpose/left_gripper": state[:, 7], "endpose/right_endpose": state[:, 8:15], "endpose/right_gripper": state[:, 15]}
        return {f"fold_cloth/data/episode{k}.hdf5": source.archive(arrays)}

    return told(recordings.merged_frames(read(spark, written(spark, sf_dir, each), "merged_h5")), number(r"episode(\d+)\.hdf5$"))


@query(sql_told(f"""n as (select *, count(*) over (partition by episode) as n, coalesce(lead(state) {W}, state) as after from traj),
    r as (select episode, frame_index, state as s, n, case when episode % 2 = 0 then list_concat(list_concat(after[1:3], {EULER('after[4:6]')}), [1 - {CLIP('after[8]')}])
      else list_concat(list_concat(state[1:3], {EULER('state[4:6]')}), [1 - {CLIP('action[16]')}]) end as a from n)""", "frame_index < (case when episode % 2 = 0 then n - 1 else n end)", "'task ' || episode"))
def recording_annotations(spark, sf_dir):
    """JSON annotations: with a state more than actions the action is the next state, else that of the same frame."""

    def each(k, state, action):
        held = {"texts": [f"task {k}"], "state": state.tolist(), "action": action[: len(action) - (k % 2 == 0)].tolist()}
        if k % 2 == 0:
            held["continuous_gripper_state"] = state[:, 7].tolist()
        return {f"annotation/train/{k}.json": json.dumps(held).encode(), f"annotation/test/{k}.json": b"{}"}

    return told(recordings.annotated_frames(read(spark, written(spark, sf_dir, each), "annotated_json")), number(r"(\d+)\.json$"))


@query(sql_told(f"""g as (select *, {RANGED('state[8]', '1.0')} as gl, case when episode % 2 = 0 then 1.0 else {RANGED('state[16]', '1.0')} end as gr from traj),
    t as (select episode, frame_index, {_arms('[state[7], state[4], state[5], state[6]]', '[state[15], state[12], state[13], state[14]]')} as s from g),
    r as (select *, coalesce(lead(s) {W}, s) as a from t)""", "true", "case when episode % 2 = 0 then 'stack the cup ' || episode else 'stack cups' end"))
def recording_prompts(spark, sf_dir):
    """The instruction follows a marker in a prompt, or is made of the folder's name; constant grippers count as 1."""

    def each(k, state, action):
        right = np.full(len(state), 0.25, np.float32) if k % 2 == 0 else state[:, 15]
        arrays = {f"puppet/end_effector_{side}_{kind}_align/data": part for side, kind, part in (("left", "pose", state[:, :7]), ("right", "pose", state[:, 8:15]), ("left", "position", state[:, 7]), ("right", "position", right))}
        if k % 2 == 0:
            arrays["prompts"] = np.array([f"The task is Described Here: stack the cup {k} "])
        return {f"a_b_c_d_stack_cups_1_2/episode_{k}.hdf5": source.archive(arrays)}

    return told(recordings.prompted_frames(read(spark, written(spark, sf_dir, each), "prompted_h5")), number(r"episode_(\d+)\.hdf5$"))


@query(sql_told(f"""m as (select min(episode) as e from traj), v as (select min(least(state[8], action[8])) as l0, max(greatest(state[8], action[8])) as l1, min(least(state[16], action[16])) as r0, max(greatest(state[16], action[16])) as r1 from traj, m where episode = e),
    g as (select episode, frame_index, action as state, 1 - {CLIP('(action[8] - l0) / (l1 - l0)')} as gl, 1 - {CLIP('(action[16] - r0) / (r1 - r0)')} as gr from traj, v),
    r as (select episode, frame_index, {_arms('[state[7], state[4], state[5], state[6]]', '[state[15], state[12], state[13], state[14]]')} as s, s as a from g)""", "true", "case when episode % 2 = 0 then 'wipe table' else 'open door' end"))
def recording_dual_arm(spark, sf_dir):
    """Commands of two arms; grippers ranged by the first container; the instruction is an attribute, here of every container."""

    def each(k, state, action):
        arrays = {f"{folder}/arm7_{part}_{side}": values[:, at : at + n] for folder, values in (("command_poses_dict", action), ("poses_dict", state)) for side, at in (("left", 0), ("right", 8)) for part, at, n in (("arm", at, 7), ("gripper", at + 7, 1))}
        return {f"{k}.hdf5": source.archive(arrays | {"@task_name": np.array(["wipe table" if k % 2 == 0 else "open door"])})}

    return told(recordings.dual_arm_frames(read(spark, written(spark, sf_dir, each), "dual_arm_h5", device="arm7")), number(r"(\d+)\.hdf5$"))


@query(sql_told(f"""k as (select unnest([0, 1]) as folder), r as (select episode * 2 + folder as episode, frame_index, state as s, list_concat(list_concat(action[1:3], {sql_unit('action[4:7]')}), [{CLIP('action[16]')}]) as a, episode as task from traj, k where folder = 0 or episode % 2 = 0)""", "true", "'task ' || task"))
def recording_folders(spark, sf_dir):
    """Step lists beside image folders: each folder that holds images is a record of its own. Plain arrays unpickle, nothing else."""

    def each(k, state, action):
        q = action[:, 3:7].astype(float)
        w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
        robot = np.zeros((len(q), 4, 4))
        robot[:, :3, :3] = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]).transpose(2, 0, 1)
        robot[:, :3, 3], robot[:, 3, 3] = action[:, :3], 1
        steps = [{"actions": a, "new_robot_transform": m} for a, m in zip(action, robot)]
        files = {"obs_dict.pkl": pickle.dumps({"state": state, "eef_transform": robot}), "policy_out.pkl": pickle.dumps(steps), "lang.txt": f"task {k}\n".encode(), "images0/im_0.jpg": b"", "images1/im_0.jpg" if k % 2 == 0 else "images1/note.txt": b"", "depth0/im_0.jpg": b""}
        return {f"day/traj{k}/{name}": data for name, data in files.items()}

    return told(recordings.folder_frames(read(spark, written(spark, sf_dir, each), "image_folders")), number(r"traj(\d+)::") * 2 + number(r"images(\d+)$"))
