"""Pose algebra queries on the trajectory binding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.functions.orientation import constrain_ray
from kinelake.operators import sequence

from .bindings import TRAJ, rounded, spread, sql_conjugate, sql_product, sql_spread, sql_unit, trajectory

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


KEYS = ("vec_id",)
POSE = "x y z qw qx qy qz"
BOTH = " ".join([f"l{n}" for n in (*POSE.split(), "grip")] + [f"r{n}" for n in (*POSE.split(), "grip")])
def by_episode():
    return Window.partitionBy("episode").orderBy("frame_index")



@query(f"with {TRAJ}, u as (select vec_id, {sql_unit('action[4:7]')} as q from traj) select vec_id, {sql_spread('q', 'qw qx qy qz')} from u")
def quat_normalize(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    return t.select("vec_id", *spread(pose.quat_normalize(pose.part(F.col("action"), 3, 4)), "qw qx qy qz"))


@query(f"with {TRAJ}, u as (select vec_id, {sql_unit('action[4:7]')} as a, {sql_unit('state[4:7]')} as b from traj), p as (select vec_id, {sql_product('a', 'b')} as m from u), r as (select vec_id, {sql_unit('m')} as q from p) select vec_id, {sql_spread('q', 'qw qx qy qz')} from r")
def quat_multiply(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    m = pose.quat_multiply(pose.part(F.col("action"), 3, 4), pose.part(F.col("state"), 3, 4))
    return t.select("vec_id", *spread(m, "qw qx qy qz"))


@query(f"with {TRAJ}, u as (select vec_id, {sql_unit('action[4:7]')} as q from traj) select vec_id, {sql_spread(sql_conjugate('q'), 'qw qx qy qz')} from u")
def quat_inverse(spark, sf_dir):
    return trajectory(spark, sf_dir).select("vec_id", *spread(pose.quat_inverse(pose.part(F.col("action"), 3, 4)), "qw qx qy qz"))




@query(f"""with {TRAJ}, r as (select *, coalesce(lag(action) over (partition by episode order by frame_index), action) as ref from traj),
    u as (select vec_id, action as t, ref, {sql_unit('ref[4:7]')} as la, {sql_unit('action[4:7]')} as lb, {sql_unit('ref[12:15]')} as ra, {sql_unit('action[12:15]')} as rb from r),
    p as (select *, {sql_product(sql_conjugate('la'), 'lb')} as lp, {sql_product(sql_conjugate('ra'), 'rb')} as rp from u),
    o as (select vec_id, [t[1] - ref[1], t[2] - ref[2], t[3] - ref[3]] || {sql_unit('lp')} || [t[8]] || [t[9] - ref[9], t[10] - ref[10], t[11] - ref[11]] || {sql_unit('rp')} || [t[16]] as d from p)
    select vec_id, {sql_spread('d', BOTH)} from o""")
def pose_delta_encode(spark, sf_dir):
    """Each command relative to the one before it; the first relative to itself."""
    t = sequence.with_previous(trajectory(spark, sf_dir), "action", ["episode"], ["frame_index"], into="ref")
    return t.select("vec_id", *spread(pose.relative16(F.col("ref"), F.col("action")), BOTH))


@query(f"""with {TRAJ}, u as (select vec_id, state as s, action as a, {sql_unit('state[4:7]')} as p, {sql_unit('action[4:7]')} as q from traj),
    m as (select *, {sql_product('p', 'q')} as r from u), o as (select vec_id, [s[1] + a[1], s[2] + a[2], s[3] + a[3]] || {sql_unit('r')} as d from m)
    select vec_id, {sql_spread('d', POSE)} from o""")
def pose_apply(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    return t.select("vec_id", *spread(pose.apply_pose(pose.part(F.col("state"), 0, 7), pose.part(F.col("action"), 0, 7)), POSE))


@query(f"""with {TRAJ} select vec_id, round(sum(action[1]) over w, 6) + 0.0 as x, round(sum(action[2]) over w, 6) + 0.0 as y, round(sum(action[3]) over w, 6) + 0.0 as z
    from traj window w as (partition by episode order by frame_index rows unbounded preceding)""")
def pose_decode_xyz(spark, sf_dir):
    """Positions of decoded deltas: running sums."""
    w = by_episode().rowsBetween(Window.unboundedPreceding, 0)
    return trajectory(spark, sf_dir).select("vec_id", *[rounded(F.sum(F.get("action", F.lit(i))).over(w)).alias(n) for i, n in enumerate("xyz")])


@query(f"""with recursive {TRAJ}, u as (select episode, frame_index, vec_id, action as a, {sql_unit('action[4:7]')} as lq, {sql_unit('action[12:15]')} as rq from traj),
    f as (select episode, frame_index, vec_id, [a[1], a[2], a[3]] as lx, lq, a[8] as lg, [a[9], a[10], a[11]] as rx, rq, a[16] as rg from u where frame_index = 0
      union all
      select u.episode, u.frame_index, u.vec_id, [f.lx[1] + a[1], f.lx[2] + a[2], f.lx[3] + a[3]], {sql_unit(sql_product('f.lq', 'u.lq'))}, a[8],
             [f.rx[1] + a[9], f.rx[2] + a[10], f.rx[3] + a[11]], {sql_unit(sql_product('f.rq', 'u.rq'))}, a[16]
      from f join u on u.episode = f.episode and u.frame_index = f.frame_index + 1),
    o as (select vec_id, lx || lq || [lg] || rx || rq || [rg] as d from f) select vec_id, {sql_spread('d', BOTH, 5)} from o""")
def pose_decode(spark, sf_dir):
    """Full sequential decoding of deltas, from the identity: an ordered fold over each episode."""
    decoded = sequence.decode_deltas(trajectory(spark, sf_dir), "action", ["episode"], ["frame_index"], keep=["vec_id"])
    return decoded.select("vec_id", *spread(F.col("decoded"), BOTH, 5))


@query(f"""with {TRAJ}, u as (select vec_id, {sql_unit('action[4:7]', False)} as a, {sql_unit('state[4:7]', False)} as b from traj),
    d as (select vec_id, least(abs(list_dot_product(a, b)), 1.0) as c from u)
    select vec_id, round(2 * acos(c), 6) + 0.0 as rad, round(degrees(2 * acos(c)), 5) + 0.0 as deg from d""")
def quat_angle(spark, sf_dir):
    angle = pose.quat_angle(pose.part(F.col("action"), 3, 4), pose.part(F.col("state"), 3, 4))
    return trajectory(spark, sf_dir).select("vec_id", rounded(angle).alias("rad"), rounded(F.degrees(angle), 5).alias("deg"))


@query(f"""with {TRAJ}, n as (select vec_id, action[4:6] as v, sqrt(list_dot_product(action[4:6], action[4:6])) as a from traj),
    q as (select vec_id, case when a <= 1e-8 then [1.0, 0.0, 0.0, 0.0]::double[] else [cos(a / 2), v[1] / a * sin(a / 2), v[2] / a * sin(a / 2), v[3] / a * sin(a / 2)] end as q, v from n)
    select vec_id, {sql_spread('q', 'qw qx qy qz')}, round(v[1], 6) + 0.0 as bx, round(v[2], 6) + 0.0 as "by", round(v[3], 6) + 0.0 as bz from q""")
def rotvec(spark, sf_dir):
    """Rotation vector to quaternion and back (small angles come back unchanged)."""
    t = trajectory(spark, sf_dir).withColumn("q", pose.rotvec_to_quat(pose.part(F.col("action"), 3, 3)))
    return t.select("vec_id", *spread(F.col("q"), "qw qx qy qz"), *spread(pose.quat_to_rotvec(F.col("q")), "bx by bz"))


@query(f"""with {TRAJ}, h as (select vec_id, cos(action[4] / 2) as cx, cos(action[5] / 2) as cy, cos(action[6] / 2) as cz, sin(action[4] / 2) as sx, sin(action[5] / 2) as sy, sin(action[6] / 2) as sz from traj),
    e as (select vec_id, [cx * cy * cz + sx * sy * sz, sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz] as k from h),
    q as (select vec_id, {sql_unit('k')} as q from e) select vec_id, {sql_spread('q', 'qw qx qy qz')} from q""")
def euler_quat(spark, sf_dir):
    return trajectory(spark, sf_dir).select("vec_id", *spread(pose.euler_to_quat(pose.part(F.col("action"), 3, 3)), "qw qx qy qz"))


@query(f"""with {TRAJ}, u as (select vec_id, {sql_unit('action[4:7]')} as q from traj), c as (select vec_id, q, q[1] as w, q[2] as x, q[3] as y, q[4] as z from u)
    select vec_id, round(1 - 2 * (y * y + z * z), 6) + 0.0 as m00, round(2 * (x * y - w * z), 6) + 0.0 as m01, round(2 * (x * z - w * y), 6) + 0.0 as m20, {sql_spread('q', 'qw qx qy qz')} from c""")
def quat_matrix(spark, sf_dir):
    """Quaternion to rotation matrix and back."""
    t = trajectory(spark, sf_dir).withColumn("m", pose.quat_to_matrix(pose.part(F.col("action"), 3, 4)))
    m = lambda i: rounded(F.get("m", F.lit(i)))
    return t.select("vec_id", m(0).alias("m00"), m(1).alias("m01"), m(6).alias("m20"), *spread(pose.matrix_to_quat(F.col("m")), "qw qx qy qz"))


@query(f"with {TRAJ}, s as (select vec_id, [action[5], action[6], action[7], action[4]] as q from traj) select vec_id, {sql_spread('q', 'qx qy qz qw')}, round(q[4], 6) + 0.0 as back_w from s")
def quat_order(spark, sf_dir):
    """wxyz to xyzw and back."""
    q = pose.to_xyzw(pose.part(F.col("action"), 3, 4))
    return trajectory(spark, sf_dir).select("vec_id", *spread(q, "qx qy qz qw"), rounded(F.get(pose.to_wxyz(q), F.lit(0))).alias("back_w"))


SCATTER = " ".join(f"c{i}" for i in range(30))
_AT = {c: i + 1 for i, c in enumerate(pose.EXECUTION_CHANNELS)}


@query(f"with {TRAJ} select vec_id, " + ", ".join(f"round({f'action[{_AT[c]}]' if c in _AT else '0.0::double'}, 6) + 0.0 as c{c}" for c in range(30)) + ", round(list_sum(action), 5) + 0.0 as back from traj")
def channel_scatter(spark, sf_dir):
    """16 channels among 30, and back."""
    v = pose.scatter30(F.col("action"))
    back = F.aggregate(pose.gather16(v), F.lit(0.0), lambda s, x: s + x)
    return trajectory(spark, sf_dir).select("vec_id", *spread(v, SCATTER), rounded(back, 5).alias("back"))


@query(f"""with recursive {TRAJ}, f as (select episode, frame_index, vec_id, action[4:7] as q from traj where frame_index = 0
    union all select t.episode, t.frame_index, t.vec_id, case when list_dot_product(f.q, t.action[4:7]) < 0 then [-e for e in t.action[4:7]] else t.action[4:7] end
    from f join traj t on t.episode = f.episode and t.frame_index = f.frame_index + 1) select vec_id, {sql_spread('q', 'qw qx qy qz')} from f""")
def sign_continuity(spark, sf_dir):
    """Quaternion signs that follow the row before; two running windows instead of a fold."""
    t = trajectory(spark, sf_dir).withColumn("q", pose.part(F.col("action"), 3, 4))
    return sequence.continuous_signs(t, "q", ["episode"], ["frame_index"]).select("vec_id", *spread(F.col("q"), "qw qx qy qz"))


@query(f"""with {TRAJ}, u as (select vec_id, {sql_unit('action[4:7]', False)} as a, {sql_unit('state[4:7]', False)} as b from traj),
    d as (select vec_id, a, case when list_dot_product(a, b) < 0 then [-e for e in b] else b end as b, abs(list_dot_product(a, b)) as c from u),
    l as (select vec_id, c, acos(least(c, 1.0)) as th, a, b, [a[i] + 0.25 * (b[i] - a[i]) for i in range(1, 5)] as lin from d),
    o as (select vec_id, case when c > 0.9995 then {sql_unit('lin', False)} else [(sin(0.75 * th) * a[i] + sin(0.25 * th) * b[i]) / sin(th) for i in range(1, 5)] end as q from l)
    select vec_id, {sql_spread('q', 'qw qx qy qz')} from o""")
def quat_slerp(spark, sf_dir):
    q = pose.slerp(pose.part(F.col("action"), 3, 4), pose.part(F.col("state"), 3, 4), F.lit(0.25))
    return trajectory(spark, sf_dir).select("vec_id", *spread(q, "qw qx qy qz"))


@query(f"""with {TRAJ} select vec_id, round(greatest(-0.1, least(0.1, action[1])), 6) + 0.0 as lx, round(greatest(0.0, least(1.0, action[8])), 6) + 0.0 as lg,
    round(greatest(0.05, greatest(-0.1, least(0.1, action[11]))), 6) + 0.0 as rz, round(greatest(0.0, least(1.0, action[16])), 6) + 0.0 as rg from traj""")
def workspace_clamp(spark, sf_dir):
    box = ((-0.1,) * 3, (0.1,) * 3)
    v = pose.clamp_workspace(F.col("action"), box, box, 0.05)
    pick = lambda i, n: rounded(F.get(v, F.lit(i))).alias(n)
    return trajectory(spark, sf_dir).select("vec_id", pick(0, "lx"), pick(7, "lg"), pick(10, "rz"), pick(15, "rg"))


@query(f"""with {TRAJ}, r as (select vec_id, action as p, [greatest(-1.0, least(1.0, e * 6)) for e in state[1:14]] as r from traj),
    v as (select *, [e * 0.3 for e in r[4:6]] as v from r), n as (select *, sqrt(list_dot_product(v, v)) as a from v),
    q as (select *, case when a <= 1e-8 then [1.0, 0.0, 0.0, 0.0]::double[] else [cos(a / 2), v[1] / a * sin(a / 2), v[2] / a * sin(a / 2), v[3] / a * sin(a / 2)] end as t, {sql_unit('p[4:7]')} as b from n),
    m as (select *, {sql_product(sql_unit('t'), 'b')} as m from q),
    o as (select vec_id, [p[1] + r[1] * 0.05, p[2] + r[2] * 0.05, p[3] + r[3] * 0.05] || {sql_unit('m')} ||
      [case when r[7] <= -0.5 then 1.0 when r[7] >= 0.5 then 1 - greatest(0.0, least(1.0, (r[7] - 0.5) / 0.5)) else greatest(0.0, least(1.0, p[8])) end] as d from m)
    select vec_id, {sql_spread('d', POSE + ' grip')} from o""")
def residual_fuse(spark, sf_dir):
    t = trajectory(spark, sf_dir)
    fused = pose.fuse_residual(F.col("action"), F.transform(pose.part(F.col("state"), 0, 14), lambda x: x * 6), 0.05, 0.3)
    return t.select("vec_id", *spread(pose.part(fused, 0, 8), POSE + " grip"))


@query(f"""with {TRAJ}, r as (select vec_id, action as p, coalesce(lag(action) over (partition by episode order by frame_index), action) as k from traj),
    u as (select *, {sql_unit('k[4:7]')} as le, {sql_unit('p[4:7]')} as lp, {sql_unit('k[12:15]')} as re, {sql_unit('p[12:15]')} as rp from r),
    m as (select *, {sql_product('le', sql_conjugate('lp'))} as lm, {sql_product('re', sql_conjugate('rp'))} as rm from u),
    n as (select *, {sql_unit('lm')} as lq, {sql_unit('rm')} as rq from m),
    h as (select *, sqrt(greatest(0.0, 1 - least(lq[1], 1.0) ** 2)) as ls, sqrt(greatest(0.0, 1 - least(rq[1], 1.0) ** 2)) as rs from n),
    v as (select *, [q * (case when ls < 1e-8 then 2.0 else 2 * acos(least(lq[1], 1.0)) / ls end) / 3.0 for q in lq[2:4]] as lv, [q * (case when rs < 1e-8 then 2.0 else 2 * acos(least(rq[1], 1.0)) / rs end) / 3.0 for q in rq[2:4]] as rv from h),
    l as (select vec_id, [(k[1] - p[1]) / 0.5, (k[2] - p[2]) / 0.5, (k[3] - p[3]) / 0.5] || lv || [k[8]] || [(k[9] - p[9]) / 0.5, (k[10] - p[10]) / 0.5, (k[11] - p[11]) / 0.5] || rv || [k[16]] as l from v)
    select vec_id, {sql_spread('l', 'lx ly lz la lb lc lg rx ry rz ra rb rc rg')},
      nullif(concat_ws(',', case when greatest(abs(l[1]), abs(l[2]), abs(l[3]), abs(l[8]), abs(l[9]), abs(l[10])) > 1.00001 then 'pose_residual_out_of_bounds' end,
        case when greatest(abs(l[4]), abs(l[5]), abs(l[6]), abs(l[11]), abs(l[12]), abs(l[13])) > 1.00001 then 'rotation_residual_out_of_bounds' end,
        case when greatest(abs(l[7]), abs(l[14])) > 1.00001 then 'gripper_label_out_of_bounds' end), '') as drop_reason from l""")
def residual_label(spark, sf_dir):
    t = sequence.with_previous(trajectory(spark, sf_dir), "action", ["episode"], ["frame_index"], into="executed")
    t = t.withColumn("label", pose.residual_label(F.col("executed"), F.col("action"), 0.5, 3.0))
    return t.select("vec_id", *spread(F.col("label"), "lx ly lz la lb lc lg rx ry rz ra rb rc rg"), pose.label_drop_reason(F.col("label")).alias("drop_reason"))


@query(f"""with {TRAJ}, r as (select vec_id, action as t, coalesce(lag(action) over (partition by episode order by frame_index), action) as p from traj),
    u as (select *, {sql_unit('p[4:7]', False)} as la, {sql_unit('t[4:7]', False)} as lb, {sql_unit('p[12:15]', False)} as ra, {sql_unit('t[12:15]', False)} as rb from r)
    select vec_id, concat_ws(',', case when not t[8] between 0 and 1 then 'left_gripper_range' end,
      case when sqrt((t[1] - p[1]) ** 2 + (t[2] - p[2]) ** 2 + (t[3] - p[3]) ** 2) > 0.2 then 'left_translation' end,
      case when degrees(2 * acos(least(abs(list_dot_product(la, lb)), 1.0))) > 90 then 'left_rotation' end,
      case when not t[16] between 0 and 1 then 'right_gripper_range' end,
      case when sqrt((t[9] - p[9]) ** 2 + (t[10] - p[10]) ** 2 + (t[11] - p[11]) ** 2) > 0.2 then 'right_translation' end,
      case when degrees(2 * acos(least(abs(list_dot_product(ra, rb)), 1.0))) > 90 then 'right_rotation' end) as violations from u""")
def step_validation(spark, sf_dir):
    t = sequence.with_previous(trajectory(spark, sf_dir), "action", ["episode"], ["frame_index"], into="prev")
    return t.select("vec_id", F.concat_ws(",", pose.step_violations(F.col("prev"), F.col("action"), 0.2, 90.0)).alias("violations"))


@query(f"""with {TRAJ}, l as (select vec_id, [-action[3], -action[1], action[2]] as v, 1 - greatest(0.0, least(1.0, (action[8] - 0.05) / 0.95)) as g,
    (1 - greatest(0.0, least(1.0, action[8]))) * 100 as cmd from traj) select vec_id, {sql_spread('v', 'x y z')}, round(g, 6) + 0.0 as grip, round(cmd, 6) + 0.0 as command from l""")
def headset_axes(spark, sf_dir):
    a = F.col("action")
    command = (1 - pose.clip(pose.at(a, 7), 0.0, 1.0)) * 100
    return trajectory(spark, sf_dir).select("vec_id", *spread(pose.headset_to_robot(pose.part(a, 0, 3)), "x y z"), rounded(pose.trigger_to_gripper(pose.at(a, 7))).alias("grip"), rounded(command).alias("command"))


@query(f"""with {TRAJ}, p as (select vec_id, action as a, coalesce(lag(action) over (partition by episode order by frame_index), action) as b from traj)
    select vec_id, 0.0::double as lx, round(b[8], 6) + 0.0 as lg_delta, round(b[1], 6) + 0.0 as lx_abs, round(a[9], 6) + 0.0 as rx from p""")
def left_lock(spark, sf_dir):
    t = sequence.with_previous(trajectory(spark, sf_dir), "action", ["episode"], ["frame_index"], into="last")
    d, a = pose.lock_left(F.col("action"), F.col("last"), "delta"), pose.lock_left(F.col("action"), F.col("last"), "absolute")
    return t.select("vec_id", rounded(pose.at(d, 0)).alias("lx"), rounded(pose.at(d, 7)).alias("lg_delta"), rounded(pose.at(a, 0)).alias("lx_abs"), rounded(pose.at(a, 8)).alias("rx"))


MATRIX = "m00 m01 m02 m10 m11 m12 m20 m21 m22"


@query(f"""with {TRAJ}, u as (select vec_id, {sql_unit('action[12:15]')} as q from traj), c as (select vec_id, q[1] as w, q[2] as x, q[3] as y, q[4] as z from u),
    m as (select vec_id, [1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)] as l, 2 * (x * z + w * y) as rx, 2 * (y * z - w * x) as ry, 1 - 2 * (x * x + y * y) as rz from c),
    h as (select *, rx / sqrt(rx * rx + ry * ry) as hx, ry / sqrt(rx * rx + ry * ry) as hy, sqrt(0.5::double) as k from m),
    t as (select *, [hx * k, hy * k, case when rz < 0 then -k else k end] as t, [rx, ry, rz] as r, [-hy, hx, 0.0::double] as f from h),
    a as (select *, [r[2] * t[3] - r[3] * t[2], r[3] * t[1] - r[1] * t[3], r[1] * t[2] - r[2] * t[1]] as a, list_dot_product(r, t) as c from t),
    p as (select *, [l[1] * c + a[2] * l[3] - a[3] * l[2] + a[1] * list_dot_product(a, l) / (1 + c), l[2] * c + a[3] * l[1] - a[1] * l[3] + a[2] * list_dot_product(a, l) / (1 + c), 0.0::double] as p from a),
    s as (select vec_id, t, case when list_dot_product(p, f) < 0 then [-e for e in f] else f end as x from p),
    o as (select vec_id, [x[1], t[2] * x[3] - t[3] * x[2], t[1], x[2], t[3] * x[1] - t[1] * x[3], t[2], x[3], t[1] * x[2] - t[2] * x[1], t[3]] as o from s)
    select vec_id, {sql_spread('o', MATRIX)} from o""")
def orientation_constraint(spark, sf_dir):
    """The right gripper's ray at a set angle to the horizontal, its level axis horizontal."""
    turned = trajectory(spark, sf_dir).withColumn("m", constrain_ray(pose.part(F.col("action"), 11, 4), angle_deg=45.0))
    return turned.select("vec_id", *spread(F.col("m"), MATRIX))
