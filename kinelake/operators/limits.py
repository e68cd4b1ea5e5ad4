"""Rate limits of command streams: each step is measured from the last limited command."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import pose

from .sequence import fold


def limit_step(previous: Column, target: Column, translation: float, rotation_deg: float, gripper: float, right_min_z: float | None = None) -> Column:
    """The command towards the target within the limits: shortened moves, turns along the arc, clipped grippers."""

    def arm(off: int) -> Column:
        p, t = pose.part(previous, off, 3), pose.part(target, off, 3)
        move = pose.let(pose.distance(t, p), lambda d: F.when(d > translation, F.zip_with(p, t, lambda a, b: a + (b - a) * (translation / d))).otherwise(t))
        q, r = pose.part(previous, off + 3, 4), pose.part(target, off + 3, 4)
        turn = pose.let(F.degrees(pose.quat_angle(q, r)), lambda a: F.when(a > rotation_deg, pose.slerp(q, r, rotation_deg / a)).otherwise(r))
        g = pose.at(previous, off + 7) + pose.clip(pose.at(target, off + 7) - pose.at(previous, off + 7), -gripper, gripper)
        if off == pose.RIGHT and right_min_z is not None:  # strictly above the bound in single precision
            floor = float(np.nextafter(np.float32(right_min_z), np.float32(np.inf)))
            move = pose.let(move, lambda m: F.array(pose.at(m, 0), pose.at(m, 1), F.greatest(pose.at(m, 2), F.lit(floor))))
        return F.concat(move, turn, F.array(pose.clip(g, 0.0, 1.0)))

    return F.concat(arm(pose.LEFT), arm(pose.RIGHT))


def rate_limited(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], keep: Sequence[str], start: Sequence[float] | None = None, **limits: float) -> DataFrame:
    """Every target limited against the limited one before it."""
    first = list(start or [0.0, 0.0, 0.0, *pose.IDENTITY, 0.0] * 2)
    rows = df.withColumn("_target", F.col(col))
    return fold(rows, by, order, [*keep, "_target"], F.array(*[F.lit(float(x)) for x in first]), lambda s, r: limit_step(s, r["_target"], **limits), "limited").drop("_target")
