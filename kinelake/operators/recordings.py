"""Aligns the frames of the ``recording`` source to states and actions: one row for each frame, arrays as Column expressions.

Every rule is a window over an episode or a group total; an episode is cut to the frames that all its arrays have. Poses
become (x, y, z, qw, qx, qy, qz), grippers numbers in [0, 1].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.operators import sequence

KEYS = ["container", "split", "episode", "instruction"]
EPISODE = ["container", "episode"]


def _has(*names: str) -> Column:
    return F.forall(F.array(*map(F.lit, names)), lambda n: F.map_contains_key("arrays", n))


def _array(name: str) -> Column:
    return F.element_at("arrays", F.lit(name))


def _first(name: str) -> Column:
    return F.get(_array(name), F.lit(0))


def _unit(x: Column, invert: bool = False) -> Column:
    y = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return 1 - y if invert else y


def _turned(p: Column, to_quat) -> Column:
    """A pose of position and any rotation as position and quaternion."""
    return F.concat(pose.part(p, 0, 3), to_quat(p))


def _xyzw(p: Column) -> Column:
    return pose.to_wxyz(pose.part(p, 3, 4))


def _out(df: DataFrame, state: Column, action: Column) -> DataFrame:
    return df.select(*KEYS, "frame_index", state.alias("state"), action.alias("action"), "cameras")


def _next_state(df: DataFrame, state: Column, last: str = "repeat") -> DataFrame:
    """The action is the state after; the last frame repeats its own ("repeat") or goes ("drop")."""
    after = F.lead("_state").over(sequence.ordered(EPISODE, ["frame_index"]))
    out = df.withColumn("_state", state).withColumn("_after", after)
    if last == "drop":
        out = out.where("_after is not null")
    return _out(out, F.col("_state"), F.coalesce("_after", "_state"))


def _ranged(df: DataFrame, names: Sequence[str], constant: str) -> DataFrame:
    """Adds ``_name``: grippers by their own range in the episode. A constant one is 1 ("one") or itself in [0, 1] ("clip")."""
    w = Window.partitionBy(*EPISODE)
    for name in names:
        x, low, high = _first(name), F.min(_first(name)).over(w), F.max(_first(name)).over(w)
        flat = F.lit(1.0) if constant == "one" else _unit(x)
        df = df.withColumn(f"_{name}", F.when(high - low < 1e-8, flat).otherwise(_unit((x - low) / (high - low))))
    return df


def split_frames(df: DataFrame) -> DataFrame:
    """Own actions; rotation vectors; open grippers are 1."""
    rows = df.where(_has("state_pose", "state_gripper", "action_pose", "action_gripper"))
    side = lambda kind: F.concat(_turned(_array(f"{kind}_pose"), lambda p: pose.rotvec_to_quat(pose.part(p, 3, 3))), F.array(_unit(_first(f"{kind}_gripper"), invert=True)))
    return _out(rows, side("state"), side("action"))


def demo_frames(df: DataFrame) -> DataFrame:
    """Euler angles; a gripper is open above 0; the action is the next state."""
    rows = df.where(_has("position", "euler", "gripper"))
    return _next_state(rows, F.concat(_array("position"), pose.euler_to_quat(_array("euler")), F.array((_first("gripper") > 0).cast("double"))))


def merged_frames(df: DataFrame) -> DataFrame:
    """Containers with end-effector poses pair each state with the one after; others have states and actions of their own."""
    own = df.where(_has("qpos", "action") & ~_has("left_pose"))
    both = df.where(_has("left_pose", "right_pose", "left_gripper", "right_gripper"))
    both = _ranged(both, ["left_gripper", "right_gripper"], "clip")
    for side in ("left", "right"):
        both = both.withColumn(f"_{side}", pose.quat_normalize(pose.part(_array(f"{side}_pose"), 3, 4)))
        both = sequence.continuous_signs(both, f"_{side}", EPISODE, ["frame_index"])
    state = F.concat(*[x for side in ("left", "right") for x in (pose.part(_array(f"{side}_pose"), 0, 3), F.col(f"_{side}"), F.array(F.col(f"_{side}_gripper")))])
    return _next_state(both, state, "drop").unionByName(_out(own, _array("qpos"), _array("action")))


def annotated_frames(df: DataFrame) -> DataFrame:
    """Where there is a state more than actions, the action is the next state; else it is the state of the same frame.

    The gripper comes from its own series if that is long enough, else from the state or the action, likewise.
    """
    w = Window.partitionBy(*EPISODE)
    n = lambda name: F.sum(_has(name).cast("int")).over(w)
    after = lambda name: F.lead(_array(name)).over(sequence.ordered(EPISODE, ["frame_index"]))
    rows = df.withColumns({"_n": n("state"), "_m": n("action"), "_g": n("gripper"), "_after": after("state"), "_grip_after": after("gripper")})
    longer = F.col("_n") > F.col("_m")
    length = F.when(longer, F.least(F.col("_m"), F.col("_n") - 1)).otherwise(F.least("_m", "_n"))
    rows = rows.withColumn("_length", length).where(F.col("frame_index") < F.col("_length"))
    last = lambda v: F.element_at(v, -1)
    grip = F.when(F.col("_g") > 0, F.when((F.col("_g") > F.col("_length")) & longer, last(F.col("_grip_after"))).when(F.col("_g") >= F.col("_length"), last(_array("gripper"))).otherwise(last(_array("action"))))
    grip = F.coalesce(grip, F.when(longer, last(F.col("_after"))).otherwise(last(_array("action"))))
    source = F.when(longer, F.col("_after")).otherwise(_array("state"))
    action = F.concat(_turned(source, lambda p: pose.euler_to_quat(pose.part(p, 3, 3))), F.array(_unit(grip, invert=True)))
    return _out(rows, _array("state"), action)


def prompted_frames(df: DataFrame) -> DataFrame:
    """Both arms; grippers by their range, a constant one counts as 1; the action is the next state."""
    rows = _ranged(df.where(_has("left_pose", "right_pose", "left_gripper", "right_gripper")), ["left_gripper", "right_gripper"], "one")
    return _next_state(rows, F.concat(*[x for side in ("left", "right") for x in (_turned(_array(f"{side}_pose"), _xyzw), F.array(F.col(f"_{side}_gripper")))]))


def dual_arm_frames(df: DataFrame, larger_is_closed: bool = True) -> DataFrame:
    """Commands of both arms. Grippers are ranged by states and commands of the first container, which stands for its folder."""
    names = [f"{kind}_{side}_gripper" for side in ("left", "right") for kind in ("state", "command")]
    first = df.agg(F.min(F.struct(F.length("container"), "container"))["container"].alias("container"))  # one row
    spec = df.join(F.broadcast(first), "container", "left_semi")
    each = lambda side, pick: pick(F.array(*[_first(n) for n in names if f"_{side}_" in n]))
    ranges = spec.agg(*[f(each(side, g)).alias(f"_{side}_{name}") for side in ("left", "right") for name, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))])
    rows = df.where(_has(*[f"command_{side}_{part}" for side in ("left", "right") for part in ("arm", "gripper")])).crossJoin(F.broadcast(ranges))  # one row

    def grip(side: str) -> Column:
        low, high = F.col(f"_{side}_low"), F.col(f"_{side}_high")
        return F.when(high - low < 1e-6, 1.0).otherwise(_unit((_first(f"command_{side}_gripper") - low) / F.greatest(high - low, F.lit(1e-6)), invert=larger_is_closed))

    state = F.concat(*[x for side in ("left", "right") for x in (_turned(_array(f"command_{side}_arm"), _xyzw), F.array(grip(side)))])
    return _out(rows, state, state)


def folder_frames(df: DataFrame) -> DataFrame:
    """One record for each image folder; actions are the commanded transforms (4 x 4, row by row) with the last channel as gripper."""
    rows = df.where(_has("state", "action", "eef", "robot"))
    m = _array("robot")
    rotation = F.array(*[F.get(m, F.lit(4 * r + c)) for r in range(3) for c in range(3)])
    place = F.array(*[F.get(m, F.lit(4 * r + 3)) for r in range(3)])
    return _out(rows, _array("state"), F.concat(place, pose.matrix_to_quat(rotation), F.array(_unit(F.element_at(_array("action"), -1)))))


ALIGNED = {
    "split_h5": split_frames, "demo_h5": demo_frames, "merged_h5": merged_frames, "annotated_json": annotated_frames,
    "prompted_h5": prompted_frames, "dual_arm_h5": dual_arm_frames, "image_folders": folder_frames,
}


def conversion_summary(frames: DataFrame, dataset: Column, strict: bool = False) -> DataFrame:
    """(dataset, status, episodes, frames, faults, error): one row for each dataset of frames that were read with
    ``errors`` = "report". A dataset with a fault has status "error" and its first fault by container and episode; ``strict``
    makes that an error of the job instead. Frames are counted by episode before they meet."""
    each = frames.withColumn("dataset", dataset).groupBy("dataset", "container", "episode", "error").agg(F.count(F.lit(1)).alias("_n"))
    fine = F.col("error").isNull()
    out = each.groupBy("dataset").agg(
        F.count(F.when(fine, True)).alias("episodes"), F.coalesce(F.sum(F.when(fine, F.col("_n"))), F.lit(0)).alias("frames"), F.count("error").alias("faults"),
        F.min(F.when(~fine, F.struct("container", "episode", "error")))["error"].alias("error"),
    )
    status = F.when(F.col("faults") == 0, "ok").otherwise(F.raise_error(F.concat_ws(": ", "dataset", "error")).cast("string") if strict else F.lit("error"))
    return out.select("dataset", status.alias("status"), "episodes", "frames", "faults", "error")
