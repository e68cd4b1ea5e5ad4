"""Joins with rules of their own: nearest state, completeness guards, visibility, lookups with alternatives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import pose


def pose_distance(a: Column, b: Column, position: float = 1.0, rotation: float = 0.5, gripper: float = 0.2) -> Column:
    """Weighted distance of two 16-channel states over both arms."""
    total = F.lit(0.0)
    for off in (pose.LEFT, pose.RIGHT):
        turn = 2 * F.acos(F.least(F.abs(pose.dot(pose.quat_normalize(pose.part(a, off + 3, 4)), pose.quat_normalize(pose.part(b, off + 3, 4)))), F.lit(1.0)))
        total = total + position * pose.distance(pose.part(a, off, 3), pose.part(b, off, 3)) + rotation * turn + gripper * F.abs(pose.at(a, off + 7) - pose.at(b, off + 7))
    return total


#: Rows of a block of one side; pairs of rows that a task holds numbers of at a time; places that have room in single precision.
BLOCK, AT_ONCE, ROOM = 8192, 1 << 17, 1e15


def tasks(df: DataFrame) -> int:
    """Tasks for rows that cost more work than their bytes tell; a number that is given is not made smaller by their bytes."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _features(state: Column) -> Column:
    """Positions, grippers and unit quaternions of both arms, 16 numbers; null where a distance would be null."""
    places = [pose.at(state, off + k) for off in (pose.LEFT, pose.RIGHT) for k in (0, 1, 2, 7)]
    turns = [pose.quat_normalize(pose.part(state, off + 3, 4)) for off in (pose.LEFT, pose.RIGHT)]
    return F.when(reduce(and_, [p.isNotNull() for p in places]), F.concat(F.array(*places), *turns))


def near_places(a: np.ndarray, b: np.ndarray, position: float = 1.0, rotation: float = 0.5, gripper: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b): for each row of ``a`` the rows of ``b`` that may be nearest, few but for equals.

    An angle is at least its chord, so a sum with chords is a lower bound of the distance; the distance to the row with the
    least bound is an upper one of the least. Rows whose bound is above it, or then whose distance is above the least by
    more than rounding explains, are left out. Bounds are in single precision, squares of lengths by products of matrices:
    each row has a margin that is more than their errors. Numbers that are not finite, or have no room, never leave a row out.
    """
    found, step, tiny = [], max(1, AT_ONCE // max(1, len(b))), float(np.finfo(np.float32).eps)
    turn = 8 * rotation * rotation  # squared weight of a chord, times two

    def rest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = 0.0
        for off in (0, 4):
            moved = [x[..., off + k] - y[..., off + k] for k in range(4)]
            out = out + position * np.sqrt(moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2]) + gripper * np.abs(moved[3])
        return out

    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cosines = [np.fmin(np.abs(sum(x[..., off + k] * y[..., off + k] for k in range(4))), 1.0) for off in (8, 12)]
        return rest(x, y) + sum(rotation * 2 * np.arccos(c) for c in cosines)

    def weighed(x: np.ndarray, fits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Positions, grippers and turns of both arms, and the margin of each row."""
        x = np.where(fits[:, None], x, 0.0)
        places = [(x[:, off : off + 3] - centre[off : off + 3]) * position for off in (0, 4)]
        grips = [(x[:, off + 3] - centre[off + 3]) * gripper for off in (0, 4)]
        margin = sum(4 * tiny**0.5 * np.sqrt((p * p).sum(axis=1)) for p in places) + sum(4 * tiny * np.abs(g) for g in grips)
        return places, grips, [x[:, off : off + 4] for off in (8, 12)], margin + 4 * (tiny * turn) ** 0.5

    with np.errstate(all="ignore"):
        fit_a, fit_b = ((np.abs(x) * max(1.0, position, gripper) < ROOM).all(axis=1) for x in (a, b))
        centre = np.median(b[fit_b], axis=0) if fit_b.any() else np.zeros(16)
        (places, grips, turns, margin), (b_places, b_grips, b_turns, b_margin) = weighed(a, fit_a), weighed(b, fit_b)
        square = lambda p: (p * p).sum(axis=1, keepdims=True)
        single = lambda *columns: np.ascontiguousarray(np.concatenate(columns, axis=1), dtype=np.float32)
        ours = [single(p, square(p), np.ones((len(p), 1))) for p in places] + [single(q) for q in turns]
        theirs = [single(-2 * p, np.ones((len(p), 1)), square(p)).T for p in b_places] + [single(turn * q).T for q in b_turns]
        grips, b_grips, below = [g.astype(np.float32) for g in grips], [g.astype(np.float32) for g in b_grips], -b_margin.astype(np.float32)
        held, odd = np.empty((2, step, len(b)), np.float32), not fit_b.all()
        for at in range(0, len(a), step):
            upto = slice(at, at + step)
            x = a[upto]
            bound, part = held[0, : len(x)], held[1, : len(x)]
            bound[:] = below
            for k in range(4):
                np.matmul(ours[k][upto], theirs[k], out=part)
                if k > 1:  # a chord from its cosine
                    np.subtract(turn, np.abs(part, out=part), out=part)
                bound += np.sqrt(np.maximum(part, 0, out=part), out=part)
            for g, h in zip(grips, b_grips):
                bound += np.abs(np.subtract(g[upto, None], h, out=part), out=part)
            if odd:
                bound[:, ~fit_b] = np.inf
            most = exact(x, b[np.argmin(bound, axis=1)])
            if odd:
                bound[:, ~fit_b] = -np.inf
            bound[~fit_a[upto]] = -np.inf
            limit = (most * (1 + 1e-6) + 1e-6 + margin[upto]) * (1 + 1e-5)
            i, j = np.nonzero(~(bound > limit.astype(np.float32)[:, None]))
            d = exact(x[i], b[j])
            least = np.full(len(x), np.inf)
            np.fmin.at(least, i, d)
            kept = ~(d > least[i] * (1 + 1e-6) + 1e-6)
            found.append((i[kept] + at, j[kept]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))


def nearest_candidates(losers: DataFrame, winners: DataFrame, pair: str, index: str, state: str, **weights: float) -> DataFrame:
    """(pair, index, state, winner index ``_j``, winner state ``_s``): the rows of :func:`nearest_state` that are compared.

    Of equal states of a pair's winner the first stays. Blocks of ``BLOCK`` rows of both sides meet, each two in one task,
    so memory is bounded and a long pair is shared by tasks; the number of comparisons is that of all pairs of rows.
    :func:`near_places` keeps those that may be nearest in their block. Where a state is missing, or not 16 numbers, all
    distances to it are null: of such winner rows a pair needs the first only.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    w = winners.groupBy(F.col(pair).alias("_p"), F.col(state).alias("_s")).agg(F.min(index).alias("_j")).withColumn("_f", _features(F.col("_s")))
    odd = w.where("_f is null").groupBy("_p").agg(F.min(F.struct("_j", "_s")).alias("_m")).select("_p", F.col("_m._j").alias("_j"), F.col("_m._s").alias("_s"))
    good = w.where("_f is not null")
    lost = losers.select(F.col(pair).alias("_p"), F.col(index).alias("_i"), F.col(state).alias("_t"), _features(F.col(state)).alias("_f"))
    first = good.groupBy("_p").agg(F.min(F.struct("_j", "_s")).alias("_m")).select("_p", F.col("_m._j").alias("_j"), F.col("_m._s").alias("_s"))
    # A loser row without a state has no distance to any row; a winner row without one is the last resort.
    plain = lost.where("_f is null").drop("_f").join(first, "_p").unionByName(lost.drop("_f").join(odd, "_p"))
    dealt = lambda key: F.pmod(F.xxhash64(key), F.col("_n"))
    blocks = lambda df: df.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("_n"))
    lost = lost.where("_f is not null")
    ours, theirs = blocks(lost), blocks(good)
    all_of = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))
    left = lost.join(ours, "_p").withColumn("_a", dealt("_i")).join(theirs.withColumnRenamed("_n", "_m"), "_p").withColumn("_b", all_of).select("_p", "_a", "_b", "_i", "_t", "_f")
    right = good.join(theirs, "_p").withColumn("_b", dealt("_j")).join(ours.withColumnRenamed("_n", "_m"), "_p").withColumn("_a", all_of).select("_p", "_a", "_b", "_j", "_s", "_f")
    names = ["_p", "_i", "_t", "_j", "_s"]
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        numbers = lambda t: pc.list_flatten(t["_f"]).to_numpy(zero_copy_only=False).reshape(-1, 16)
        i, j = near_places(numbers(a), numbers(b), **weights) if a.num_rows and b.num_rows else ([], [])
        x, y = a.take(pa.array(i, pa.int64())), b.take(pa.array(j, pa.int64()))
        return pa.table([*(x[c] for c in names[:3]), *(y[c] for c in names[3:])], names=names)

    keys = ["_p", "_a", "_b"]
    left, right = (df.repartition(tasks(losers), *keys) for df in (left, right))
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ", ".join(f"{c} {kinds[c]}" for c in names))
    both = met.unionByName(plain)
    return both.select(F.col("_p").alias(pair), F.col("_i").alias(index), F.col("_t").alias(state), "_j", "_s")


def nearest_state(losers: DataFrame, winners: DataFrame, pair: str, index: str, state: str, **weights: float) -> DataFrame:
    """Each loser row with the index of its pair's nearest winner row; the first wins a tie.

    Rows meet inside a pair only, by :func:`nearest_candidates`. A winner row without a distance (a null state) is taken
    only where the pair has no other.
    """
    d = nearest_candidates(losers, winners, pair, index, state, **weights)
    d = d.withColumn("_d", pose_distance(F.col(state), F.col("_s"), **weights))
    best = F.min(F.struct(F.col("_d").isNull().alias("none"), F.col("_d").alias("d"), F.col("_j").alias("j")))
    return d.groupBy(pair, index).agg(best.alias("m")).select(pair, index, F.col("m.j").alias("winner_index"), F.col("m.d").alias("distance"))


def visible(seq: Column, frame: Column, modality: Column, noise: Column, k_seq: Column, k_frame: Column, k_modality: Column, k_noise: Column) -> Column:
    """Whether a token (q) sees another one (k) of its sequence. Modality 0 is video, 1 is action; noise 1 is noisy, 0 clean."""
    same = (seq == k_seq) & (seq >= 0)
    video = (modality == 0) & (k_modality == 0)
    clean_video = video & (noise == 0) & (frame == 0) & (k_frame == 0)
    noisy_video = video & (noise == 1) & (frame > 0) & (k_frame >= 0)
    from_video = (modality == 1) & (noise == 1) & (k_modality == 0) & (k_noise == 0) & (k_frame == 0)
    actions = (modality == 1) & (k_modality == 1)
    state = actions & (noise == 0) & (k_noise == 0) & (frame < 0) & (k_frame < 0)
    from_state = actions & (noise == 1) & (k_noise == 0) & (k_frame < 0)
    noisy = actions & (noise == 1) & (k_noise == 1)
    return same & (clean_video | noisy_video | from_video | state | from_state | noisy)


def token_visibility(tokens: DataFrame, id_col: str = "token") -> DataFrame:
    """(q, k): pairs of tokens of one sequence that see each other; joined by sequence, which bounds the pairs."""
    names = ("seq", "frame", "modality", "noise")
    q = tokens.select(F.col(id_col).alias("q"), *[F.col(n).alias(f"q_{n}") for n in names])
    k = tokens.select(F.col(id_col).alias("k"), *[F.col(n).alias(f"k_{n}") for n in names])
    rule = visible(*[F.col(f"q_{n}") for n in names], *[F.col(f"k_{n}") for n in names])
    return q.join(k, F.col("q_seq") == F.col("k_seq")).where(rule).select("q", "k")


def visibility_blocks(tokens: DataFrame, id_col: str = "token") -> DataFrame:
    """(seq, q_first, q_last, k_first, k_last): what :func:`token_visibility` says, as ranges of tokens.

    Neighbouring tokens (by id) of one sequence, frame, modality and noise are one run, and runs see each other as their
    tokens do: a mask costs a row for each pair of runs, whatever their lengths. A sequence's ids must be dense; a gap
    ends a run.
    """
    names = ["seq", "frame", "modality", "noise"]
    place = F.row_number().over(Window.partitionBy(*names).orderBy(id_col))
    runs = tokens.withColumn("_run", F.col(id_col) - place).groupBy(*names, "_run").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
    q, k = (runs.select(*[F.col(n).alias(f"{p}_{n}") for n in (*names, "first", "last")]) for p in "qk")
    rule = visible(*[F.col(f"{p}_{n}") for p in "qk" for n in names])
    met = q.join(k, F.col("q_seq") == F.col("k_seq")).where(rule)
    return met.select(F.col("q_seq").alias("seq"), "q_first", "q_last", "k_first", "k_last")


def expanded(blocks: DataFrame) -> DataFrame:
    """The (q, k) pairs of :func:`visibility_blocks`."""
    q = blocks.withColumn("q", F.explode(F.sequence("q_first", "q_last")))
    return q.withColumn("k", F.explode(F.sequence("k_first", "k_last"))).select("q", "k")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], table_keys: Sequence[str], value: str, into: str) -> DataFrame:
    """A value by the first of several alternative keys that the table knows."""
    out, found = df, []
    for i, (k, t) in enumerate(zip(keys, table_keys)):
        own = table.select(F.col(t).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).dropDuplicates([f"_k{i}"])
        out = out.join(own, F.col(k) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return out.withColumn(into, F.coalesce(*found)).drop(*found)


def remap_complete(rows: DataFrame, mapping: DataFrame, key: str, new_key: str, owner: str) -> DataFrame:
    """Rows with their new key, for owners all of whose rows have one; nothing of the others."""
    joined = rows.join(mapping.select(key, new_key), key, "left")
    missing = F.sum(F.col(new_key).isNull().cast("int")).over(Window.partitionBy(owner))
    return joined.withColumn("_missing", missing).where("_missing = 0").drop("_missing")


def reference_pairs(df: DataFrame, state: str, action: str, by: Sequence[str], order: Sequence[str], into: str = "reference") -> DataFrame:
    """What each action is relative to: the state for the first row, the action before it for the others."""
    return df.withColumn(into, F.coalesce(F.lag(action).over(Window.partitionBy(*by).orderBy(*order)), F.col(state)))
