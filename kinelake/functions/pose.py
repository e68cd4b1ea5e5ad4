"""Pose algebra as Column expressions: quaternions (w, x, y, z) and poses (x, y, z, w, x, y, z) as arrays of doubles.

``let`` names an intermediate value inside an expression, so that it is computed once and the expression stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8
LEFT, RIGHT = 0, 8  # offsets of the arms in a 16-channel command
#: Channels of a 30-channel vector that hold the 16 of a command; the others are for release poses.
EXECUTION_CHANNELS = (*range(0, 7), 28, *range(7, 14), 29)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def part(v: Column, start: int, length: int) -> Column:
    return F.slice(v, start + 1, length)


def dot(a: Column, b: Column, n: int = 4) -> Column:
    """Of the first ``n`` channels, written out: fewer lambdas to resolve, and compiled code."""
    return sum((at(a, i) * at(b, i) for i in range(1, n)), at(a, 0) * at(b, 0))


def norm(v: Column, n: int = 4) -> Column:
    return F.sqrt(dot(v, v, n))


def distance(a: Column, b: Column) -> Column:
    """Of two positions."""
    return F.sqrt(sum(((at(a, i) - at(b, i)) * (at(a, i) - at(b, i)) for i in range(1, 3)), (at(a, 0) - at(b, 0)) * (at(a, 0) - at(b, 0))))


def scale(v: Column, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(v, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, as_col(low)), as_col(high))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


IDENTITY = (1.0, 0.0, 0.0, 0.0)


def quat_normalize(q: Column, canonical: bool = True) -> Column:
    """Unit length; the identity for a zero quaternion; with ``canonical`` of q and -q the one with w >= 0."""

    def unit(u: Column) -> Column:
        sign = F.when(at(u, 0) < 0, -1.0).otherwise(1.0) if canonical else F.lit(1.0)
        return let(sign / F.greatest(norm(u), F.lit(TINY)), lambda k: F.when(norm(u) > TINY, F.array(*[at(u, i) * k for i in range(4)])).otherwise(F.array(*map(F.lit, IDENTITY))))

    return let(q, unit)


def quat_multiply(a: Column, b: Column) -> Column:
    """Hamilton product of the normalised factors, normalised."""

    def product(p: Column, q: Column) -> Column:
        w, x, y, z = (at(p, i) for i in range(4))
        s, t, u, v = (at(q, i) for i in range(4))
        return F.array(w * s - x * t - y * u - z * v, w * t + x * s + y * v - z * u, w * u - x * v + y * s + z * t, w * v + x * u - y * t + z * s)

    return quat_normalize(let(quat_normalize(a), lambda p: let(quat_normalize(b), lambda q: product(p, q))))


def quat_inverse(q: Column) -> Column:
    return let(quat_normalize(q), lambda u: F.array(at(u, 0), -at(u, 1), -at(u, 2), -at(u, 3)))


def quat_angle(a: Column, b: Column) -> Column:
    """Angle between rotations in radians."""
    return 2 * F.acos(F.least(F.abs(dot(quat_normalize(a), quat_normalize(b))), F.lit(1.0)))


def slerp(a: Column, b: Column, t: Column, near: float = 0.9995) -> Column:
    """Shortest-path interpolation; almost equal rotations are mixed linearly and normalised."""

    def between(p: Column, q: Column, d: Column) -> Column:
        line = quat_normalize(F.zip_with(p, q, lambda x, y: x + t * (y - x)), canonical=False)
        arc = let(F.acos(F.least(d, F.lit(1.0))), lambda th: F.zip_with(p, q, lambda x, y: (F.sin((1 - t) * th) * x + F.sin(t * th) * y) / F.sin(th)))
        return F.when(d > near, line).otherwise(arc)

    def aligned(p: Column, q: Column) -> Column:
        return let(dot(p, q), lambda d: F.when(d < 0, between(p, scale(q, -1), -d)).otherwise(between(p, q, d)))

    return let(quat_normalize(a, False), lambda p: let(quat_normalize(b, False), lambda q: aligned(p, q)))


def relative_pose(reference: Column, target: Column) -> Column:
    """World difference of positions; local rotation from the reference to the target."""
    turn = quat_multiply(quat_inverse(part(reference, 3, 4)), part(target, 3, 4))
    return F.concat(sub(part(target, 0, 3), part(reference, 0, 3)), turn)


def apply_pose(reference: Column, delta: Column) -> Column:
    return F.concat(add(part(reference, 0, 3), part(delta, 0, 3)), quat_multiply(part(reference, 3, 4), part(delta, 3, 4)))


def both_arms(make: Callable[[int], Column], gripper: Callable[[int], Column]) -> Column:
    """A 16-channel vector from each arm's pose and gripper."""
    return F.concat(*[c for off in (LEFT, RIGHT) for c in (make(off), F.array(gripper(off)))])


def relative16(reference: Column, target: Column) -> Column:
    """Both arms relative to the reference; grippers stay absolute."""
    return both_arms(lambda o: relative_pose(part(reference, o, 7), part(target, o, 7)), lambda o: at(target, o + 7))


def apply16(reference: Column, delta: Column) -> Column:
    return both_arms(lambda o: apply_pose(part(reference, o, 7), part(delta, o, 7)), lambda o: at(delta, o + 7))


def scatter30(v16: Column) -> Column:
    """16 execution channels at their places among 30; 0 elsewhere."""
    place = {c: i for i, c in enumerate(EXECUTION_CHANNELS)}
    return F.array(*[at(v16, place[c]) if c in place else F.lit(0.0) for c in range(30)])


def release30(v16: Column, reference: Column, release: Column, left_valid: Column, right_valid: Column) -> tuple[Column, Column]:
    """The 30 channels with both arms' release poses relative to ``reference`` in 14 to 27, and their mask."""
    poses = F.concat(*[relative_pose(part(reference, o, 7), part(release, o, 7)) for o in (LEFT, RIGHT)])
    values = let(poses, lambda r: let(scatter30(v16), lambda v: F.concat(F.slice(v, 1, 14), r, F.slice(v, 29, 2))))
    mask = F.concat(F.array_repeat(F.lit(True), 14), F.array_repeat(left_valid, 7), F.array_repeat(right_valid, 7), F.array_repeat(F.lit(True), 2))
    return values, mask


def split16(v16: Column) -> Column:
    """A command by name: pose and gripper of either arm."""
    return F.struct(part(v16, LEFT, 7).alias("left_pose"), at(v16, 7).alias("left_gripper"), part(v16, RIGHT, 7).alias("right_pose"), at(v16, 15).alias("right_gripper"))


def assemble16(parts: Column) -> Column:
    return F.concat(parts["left_pose"], F.array(parts["left_gripper"]), parts["right_pose"], F.array(parts["right_gripper"]))


def gather16(v30: Column) -> Column:
    return F.array(*[at(v30, c) for c in EXECUTION_CHANNELS])


def execution_mask() -> Column:
    return F.array(*[F.lit(c in EXECUTION_CHANNELS) for c in range(30)])


def to_xyzw(q: Column) -> Column:
    return F.array(at(q, 1), at(q, 2), at(q, 3), at(q, 0))


def to_wxyz(q: Column) -> Column:
    return F.array(at(q, 3), at(q, 0), at(q, 1), at(q, 2))


def rotvec_to_quat(v: Column) -> Column:
    def turned(angle: Column) -> Column:
        return F.concat(F.array(F.cos(angle / 2)), F.transform(v, lambda x: x / angle * F.sin(angle / 2)))

    return let(norm(v, 3), lambda a: F.when(a <= TINY, F.array(*map(F.lit, IDENTITY))).otherwise(turned(a)))


def quat_to_rotvec(q: Column) -> Column:
    """Axis times angle of the shorter turn."""

    def vector(u: Column) -> Column:
        xyz, w = part(u, 1, 3), F.least(at(u, 0), F.lit(1.0))
        half = F.sqrt(F.greatest(F.lit(0.0), 1 - w * w))
        return let(half, lambda s: F.when(s < TINY, scale(xyz, 2)).otherwise(F.transform(xyz, lambda x: x * (2 * F.acos(w) / s))))

    return let(quat_normalize(q), vector)


def quat_to_matrix(q: Column) -> Column:
    """Row-major 3 x 3 rotation matrix."""

    def matrix(u: Column) -> Column:
        w, x, y, z = (at(u, i) for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return let(quat_normalize(q), matrix)


def matrix_to_quat(m: Column) -> Column:
    """From a row-major rotation matrix; the branch with the largest divisor keeps precision."""
    g = lambda r, c: at(m, 3 * r + c)
    trace = g(0, 0) + g(1, 1) + g(2, 2)

    def by_axis(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        size = 2 * F.sqrt(1 + g(i, i) - g(j, j) - g(k, k))
        xyz: list[Column] = [F.lit(0.0)] * 3
        xyz[i], xyz[j], xyz[k] = size / 4, (g(i, j) + g(j, i)) / size, (g(i, k) + g(k, i)) / size
        return F.array((g(k, j) - g(j, k)) / size, *xyz)

    whole = 2 * F.sqrt(trace + 1)
    by_trace = F.array(whole / 4, (g(2, 1) - g(1, 2)) / whole, (g(0, 2) - g(2, 0)) / whole, (g(1, 0) - g(0, 1)) / whole)
    largest = F.when((g(0, 0) >= g(1, 1)) & (g(0, 0) >= g(2, 2)), by_axis(0)).when(g(1, 1) >= g(2, 2), by_axis(1)).otherwise(by_axis(2))
    return quat_normalize(F.when(trace > 0, by_trace).otherwise(largest))


def euler_to_quat(e: Column) -> Column:
    """Extrinsic x, y, z angles in radians."""
    cx, cy, cz = (F.cos(at(e, i) / 2) for i in range(3))
    sx, sy, sz = (F.sin(at(e, i) / 2) for i in range(3))
    return quat_normalize(F.array(cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz))


def clamp_workspace(v16: Column, left: tuple[Sequence[float], Sequence[float]] | None = None, right: tuple[Sequence[float], Sequence[float]] | None = None, right_min_z: float | None = None) -> Column:
    """Positions into each arm's box, the right arm above a height, grippers into [0, 1]."""
    out = [at(v16, i) for i in range(16)]
    for off, box in ((LEFT, left), (RIGHT, right)):
        if box:
            for k in range(3):
                out[off + k] = clip(out[off + k], box[0][k], box[1][k])
        out[off + 7] = clip(out[off + 7], 0.0, 1.0)
    if right_min_z is not None:
        out[RIGHT + 2] = F.greatest(out[RIGHT + 2], F.lit(float(right_min_z)))
    return F.array(*out)


def fuse_residual(prior: Column, residual: Column, position_scale: float, rotation_scale: float, deadband: float = 0.5) -> Column:
    """A prior command corrected by a clipped 14-channel residual: offsets, turns before the prior's, and a gripper with a dead band."""
    r = F.transform(residual, lambda x: clip(x, -1.0, 1.0))

    def pose(off: int) -> Column:
        base = 0 if off == LEFT else 7
        turn = rotvec_to_quat(scale(part(r, base + 3, 3), rotation_scale))
        return F.concat(add(part(prior, off, 3), scale(part(r, base, 3), position_scale)), quat_multiply(turn, part(prior, off + 3, 4)))

    def gripper(off: int) -> Column:
        g = at(r, 6 if off == LEFT else 13)
        close = clip((g - deadband) / max(1 - deadband, 1e-6), 0.0, 1.0)
        return F.when(g <= -deadband, 1.0).when(g >= deadband, 1 - close).otherwise(clip(at(prior, off + 7), 0.0, 1.0))

    return both_arms(pose, gripper)


def residual_label(executed: Column, prior: Column, position_scale: float, rotation_scale: float) -> Column:
    """The 14-channel residual that leads from the prior to what was executed; grippers absolute."""

    def arm(off: int) -> Column:
        turn = quat_multiply(part(executed, off + 3, 4), quat_inverse(part(prior, off + 3, 4)))
        offset = scale(sub(part(executed, off, 3), part(prior, off, 3)), 1 / max(position_scale, TINY))
        return F.concat(offset, scale(quat_to_rotvec(turn), 1 / max(rotation_scale, TINY)), F.array(at(executed, off + 7)))

    return F.concat(arm(LEFT), arm(RIGHT))


def label_drop_reason(label: Column, bound: float = 1.0, tolerance: float = 1e-5) -> Column:
    """Comma-joined reasons against a residual label; null if it is valid."""
    limit = bound + tolerance
    worst = lambda ids: F.greatest(*[F.abs(at(label, i)) for i in ids])
    reasons = F.concat_ws(
        ",",
        F.when(worst((0, 1, 2, 7, 8, 9)) > limit, F.lit("pose_residual_out_of_bounds")),
        F.when(worst((3, 4, 5, 10, 11, 12)) > limit, F.lit("rotation_residual_out_of_bounds")),
        F.when(worst((6, 13)) > limit, F.lit("gripper_label_out_of_bounds")),
    )
    return F.nullif(reasons, F.lit(""))


def step_violations(previous: Column, target: Column, max_translation: float, max_rotation_deg: float, box: tuple[Sequence[float], Sequence[float]] | None = None) -> Column:
    """Names of the limits that a step breaks; an empty array for a valid step."""
    checks: list[tuple[str, Column]] = [("not_finite", ~F.forall(target, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))]
    for name, off in (("left", LEFT), ("right", RIGHT)):
        checks += [
            (f"{name}_zero_quaternion", norm(part(target, off + 3, 4)) <= TINY),
            (f"{name}_gripper_range", ~at(target, off + 7).between(0.0, 1.0)),
            (f"{name}_translation", distance(part(target, off, 3), part(previous, off, 3)) > max_translation),
            (f"{name}_rotation", F.degrees(quat_angle(part(previous, off + 3, 4), part(target, off + 3, 4))) > max_rotation_deg),
        ]
        if box:
            inside = F.lit(True)
            for k in range(3):
                inside = inside & at(target, off + k).between(float(box[0][k]), float(box[1][k]))
            checks.append((f"{name}_workspace", ~inside))
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())


def lock_left(delta: Column, last: Column, representation: str) -> Column:
    """Holds the left arm: no motion for deltas (gripper kept), the last command for absolute targets."""
    if representation == "delta":
        held = F.concat(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, *IDENTITY)]), F.array(at(last, 7)))
    elif representation == "absolute":
        held = part(last, 0, 8)
    else:
        raise ValueError("representation must be 'absolute' or 'delta'")
    return F.concat(held, part(delta, 8, 8))


def quantile_normalize(v: Column, low: Column, high: Column, limit: float | None = 1.5) -> Column:
    """Each channel to [-1, 1] between its quantiles, clipped at ``limit`` (None: not)."""
    made = F.zip_with(v, F.arrays_zip(low.alias("l"), high.alias("h")), lambda x, q: (x - q["l"]) / (q["h"] - q["l"] + 1e-6) * 2 - 1)
    return made if limit is None else F.transform(made, lambda x: clip(x, -limit, limit))


def quantile_denormalize(v: Column, low: Column, high: Column) -> Column:
    return F.zip_with(v, F.arrays_zip(low.alias("l"), high.alias("h")), lambda x, q: (x + 1) / 2 * (q["h"] - q["l"] + 1e-6) + q["l"])


def headset_to_robot(v: Column) -> Column:
    """Axes of a headset (right, up, back) as those of a robot (forward, left, up)."""
    return F.array(-at(v, 2), -at(v, 0), at(v, 1))


def trigger_to_gripper(trigger: Column, dead: float = 0.05) -> Column:
    """Open (1) below the dead zone, then linearly down to closed (0)."""
    return 1 - clip((trigger - dead) / (1 - dead), 0.0, 1.0)
