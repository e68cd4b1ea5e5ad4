"""Pose conversions by metadata, camera order, timing shares, winner transitions, resume points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import pose

from .sequence import with_previous


def pose12_to_pose16(v: Column, left_grip: Column, right_grip: Column) -> Column:
    """Two arms of xyz and roll, pitch, yaw, and two grippers, as a 16-channel command."""
    arm = lambda o: F.concat(pose.part(v, o, 3), pose.euler_to_quat(pose.part(v, o + 3, 3)))
    return F.concat(arm(0), F.array(left_grip), arm(6), F.array(right_grip))


def pose16_from_xyzw(v: Column) -> Column:
    """A 16-channel command whose quaternions come as x, y, z, w."""
    arm = lambda o: F.concat(pose.part(v, o, 3), pose.quat_normalize(pose.to_wxyz(pose.part(v, o + 3, 4))), F.array(pose.at(v, o + 7)))
    return F.concat(arm(pose.LEFT), arm(pose.RIGHT))


def conversion_reason(width: Column, rotation: Column) -> Column:
    """Why an episode is not converted; null if it is."""
    return (
        F.when(width.isNull(), "no_action")
        .when(~width.isin(12, 14, 16), "unknown_width")
        .when((width == 16) & ~F.coalesce(rotation, F.lit("")).isin("wxyz", "xyzw"), "unknown_rotation")
    )


def camera_order(df: DataFrame, by: Sequence[str], camera: str, y: str) -> DataFrame:
    """Cameras of each episode from left (largest mean y) to right; NaN is left out, cameras without a value come last.

    Cameras with equal means are in the order of their names. Sums of doubles differ by the order of their rows, so means
    are those of decimals; plain ones only for episodes with a value that has not at most 18 places, or means of 10^16 on.
    """
    value = F.nanvl(F.col(y), F.lit(None).cast("double"))
    places = value.try_cast("decimal(38,18)")
    same = F.coalesce(places.cast("double") == value, value.isNull())
    each = df.groupBy(*by, camera).agg(F.avg(value).alias("_m"), F.try_avg(places).alias("_d"), F.bool_and(same).alias("_e"))
    exact = F.bool_and(F.col("_e") & (F.col("_m").isNull() | F.col("_d").isNotNull()))
    found = F.collect_list(F.struct(F.col("_m").isNull().alias("none"), (-F.col("_d")).alias("d"), (-F.col("_m")).alias("m"), F.col(camera).alias("c")))
    grouped = each.groupBy(*by).agg(found.alias("_f"), exact.alias("_x"))
    keys = F.transform("_f", lambda s: F.struct(s["none"].alias("none"), F.when(F.col("_x"), s["d"]).alias("d"), F.when(~F.col("_x"), s["m"]).alias("m"), s["c"].alias("c")))
    return grouped.select(*by, F.transform(F.array_sort(keys), lambda s: s["c"]).alias("cameras"))


def step_timing(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Mean time of each stage and its share of all time."""
    each = df.groupBy(stage).agg(F.avg(seconds).alias("mean"), F.sum(seconds).alias("_total"))
    total = each.agg(F.sum("_total").alias("_all"))
    return each.join(F.broadcast(total)).select(stage, "mean", (F.col("_total") / F.col("_all")).alias("share"))  # one row


def winner_transitions(df: DataFrame, state: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each state relative to the one recorded before it; the first row of a recording has none."""
    seen = with_previous(df, state, by, order, "_prev").withColumn("_first", F.row_number().over(_w(by, order)) == 1)
    return seen.where("not _first").withColumn("delta", pose.relative16(F.col("_prev"), F.col(state))).drop("_prev", "_first")


def _w(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def next_episode(attempts: DataFrame, by: Sequence[str], saved: str) -> DataFrame:
    """Where each task resumes: the number of its saved episodes."""
    return attempts.groupBy(*by).agg(F.sum(F.col(saved).cast("long")).alias("next_episode"))
