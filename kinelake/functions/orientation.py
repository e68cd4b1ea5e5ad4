"""Orientation constraint of a gripper: its ray at a set angle to the horizontal, a second axis level.

The frame is put together from what is asked of it. The ray keeps its heading and gets the angle. A level axis that is
square to the ray can only lie along the horizontal line square to it, one way or the other; the third axis follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pose

AXES = {"x": 0, "y": 1, "z": 2}
#: Below this length a direction has no heading.
FLAT = 1e-8


def _axis(name: str) -> tuple[int, float]:
    """Number and sign of a body axis."""
    return AXES[name[-1]], -1.0 if name.startswith("-") else 1.0


def _direction(m: Column, axis: int, sign: float = 1.0) -> Column:
    """Where a body axis points: a column of the row-major matrix."""
    return F.array(*[pose.at(m, 3 * row + axis) * sign for row in range(3)])


def _cross(a: Column, b: Column) -> Column:
    turn = ((1, 2), (2, 0), (0, 1))
    return F.array(*[pose.at(a, i) * pose.at(b, j) - pose.at(a, j) * pose.at(b, i) for i, j in turn])


def _carried(v: Column, src: Column, dst: Column) -> Column:
    """``v`` turned as the shortest turn from ``src`` to ``dst`` does; the two are not opposite."""

    def turned(axis: Column) -> Column:
        cosine, along = pose.dot(src, dst, 3), pose.dot(axis, v, 3) / (1 + pose.dot(src, dst, 3))
        square = _cross(axis, v)
        return F.array(*[pose.at(v, k) * cosine + pose.at(square, k) + pose.at(axis, k) * along for k in range(3)])

    return pose.let(_cross(src, dst), turned)


def _heading(m: Column, ray: Column) -> Column:
    """The ray's horizontal direction (x, y); a vertical ray takes that of the body's y axis, or else the world's x."""
    out = F.array(F.lit(1.0), F.lit(0.0))
    for v in (_direction(m, AXES["y"]), ray):
        length = F.sqrt(pose.dot(v, v, 2))
        out = F.when(length >= FLAT, F.array(pose.at(v, 0) / length, pose.at(v, 1) / length)).otherwise(out)
    return out


def constrain_ray(q: Column, angle_deg: float = 45.0, ray_axis: str = "+z", level_axis: str | None = "+x") -> Column:
    """Row-major rotation matrices of quaternions (w, x, y, z) with the constraint applied.

    A ray that points down stays below the horizontal. Of the two level directions the nearer one is taken, as seen after
    the shortest turn of the ray. A vertical ray, or a level axis that is the ray, leaves it at that turn.
    """
    if not 0 <= angle_deg <= 90:
        raise ValueError("the angle to the horizontal is between 0 and 90 degrees")
    angle = math.radians(angle_deg)
    number, sign = _axis(ray_axis)
    other, other_sign = _axis(level_axis) if level_axis else (number, sign)

    def rows(axes: dict[int, Column]) -> Column:
        return F.array(*[pose.at(axes[k], row) for row in range(3) for k in range(3)])

    def framed(m: Column, ray: Column, aim: Column) -> Column:
        if other == number or angle_deg == 90:
            return rows({k: _carried(_direction(m, k), ray, aim) for k in range(3)})

        def level(flat: Column) -> Column:
            side = F.when(pose.dot(_carried(_direction(m, other, other_sign), ray, aim), flat, 3) < 0, -1.0).otherwise(1.0)
            along = pose.let(side, lambda s: pose.scale(flat, s * other_sign))
            third = 3 - number - other
            right_handed = (number + 1) % 3 == other  # ray, level, third in the order x, y, z

            def whole(lv: Column, ry: Column) -> Column:
                return rows({number: ry, other: lv, third: _cross(ry, lv) if right_handed else _cross(lv, ry)})

            return pose.let(along, lambda lv: pose.let(pose.scale(aim, sign), lambda ry: whole(lv, ry)))

        horizontal = F.array(-pose.at(aim, 1) / math.cos(angle), pose.at(aim, 0) / math.cos(angle), F.lit(0.0))
        return pose.let(horizontal, level)

    def aimed(m: Column, ray: Column) -> Column:
        up = F.when(pose.at(ray, 2) < 0, -math.sin(angle)).otherwise(math.sin(angle))
        aim = pose.let(_heading(m, ray), lambda h: F.array(pose.at(h, 0) * math.cos(angle), pose.at(h, 1) * math.cos(angle), up))
        return pose.let(aim, lambda a: framed(m, ray, a))

    return pose.let(pose.quat_to_matrix(q), lambda m: pose.let(_direction(m, number, sign), lambda ray: aimed(m, ray)))
