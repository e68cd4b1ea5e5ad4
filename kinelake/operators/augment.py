"""Preference augmentation: dense winner and loser chunks from trajectory pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import pose

from . import joins, resample, windows


def augment_pairs(losers: DataFrame, winners: DataFrame, pair: str, index: str, state: str, action: str, horizon: int = 16, fraction: float = 0.5, **bridge: float) -> DataFrame:
    """(pair, frame index, kind, winner, loser): one sample for each loser row with a complete chunk, and each winner row.

    Stored actions are deltas on their own row's state. A negative sample pairs the loser's chunk with a bridge from the
    loser's state into the winner's chunk at its nearest state; a positive one has the winner's chunk on both sides.
    """
    absolute = lambda df: df.withColumn("_target", pose.apply16(F.col(state), F.col(action)))
    chunks = lambda df: windows.lookahead(absolute(df), "_target", horizon, [pair], [index], "_chunk")
    won, lost = chunks(winners), windows.complete_chunks(chunks(losers), horizon, [pair], [index])
    n = max(1, min(horizon, round(horizon * fraction)))
    # The command after the bridge is in the winner's chunk, or beyond it its last one.
    arrival = F.get("_wchunk", F.lit(min(n, horizon - 1)))
    near = joins.nearest_state(lost, winners, pair, index, state)
    target = won.select(F.col(pair), F.col(index).alias("winner_index"), F.col("_chunk").alias("_wchunk"))
    # Chunks are in order in one task for a pair; the bridges, whose work is greater by far, are dealt by rows.
    met = lost.join(near, [pair, index]).join(target, [pair, "winner_index"]).repartition(joins.tasks(losers), pair, index)
    path = resample.bridge(F.col(state), F.col("_wchunk"), arrival, horizon, fraction, **bridge)
    negative = met.select(pair, index, F.lit("negative").alias("kind"), path.alias("winner"), F.col("_chunk").alias("loser"))
    positive = won.select(pair, index, F.lit("positive").alias("kind"), F.col("_chunk").alias("winner"), F.col("_chunk").alias("loser"))
    return negative.unionByName(positive)


def sample_counts(losers: DataFrame, winners: DataFrame, pair: str, horizon: int = 16) -> DataFrame:
    """(pair, kind, n): how many samples :func:`augment_pairs` has, from the lengths of both sides.

    Every loser row with a complete chunk has one nearest winner row where the pair has a winner at all, so neither states
    nor actions are read.
    """
    lost, won = (df.groupBy(pair).agg(F.count(F.lit(1)).alias("n")) for df in (losers, winners))
    negative = lost.join(won.select(pair), pair).select(pair, F.lit("negative").alias("kind"), (F.col("n") - horizon + 1).alias("n"))
    return negative.where("n > 0").unionByName(won.select(pair, F.lit("positive").alias("kind"), "n"))
