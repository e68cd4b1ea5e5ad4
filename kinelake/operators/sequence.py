"""Ordered operators inside an episode: previous rows, folds, sign continuity, edges, running schedules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import pose
from kinelake.operators import indexing

#: Rows of a fold whose outputs are gathered at a time.
STRETCH = 128


def ordered(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def with_previous(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """The value of the row before; the first row has its own."""
    return df.withColumn(into, F.coalesce(F.lag(col).over(ordered(by, order)), F.col(col)))


def with_next(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """The value of the row after; the last row has its own."""
    return df.withColumn(into, F.coalesce(F.lead(col).over(ordered(by, order)), F.col(col)))


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str], start: Column, step: Callable[[Column, Column], Column], into: str) -> DataFrame:
    """A left fold over each group in order, one output row for each input row.

    ``step(state, row)`` gives the next state; ``row`` has the columns of ``order`` and ``keep``. For folds that no window
    function states. A group is one task's work: groups are episodes, whose length is bounded by a recording.
    """
    names = list(dict.fromkeys([*order, *keep]))
    row = F.struct(*[F.col(c) for c in names])
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kind = _type(df, start, "s")
    held = lambda form, state: F.struct(F.array().cast(form).alias("done"), state.alias("state"))
    append = lambda acc, out, state: F.struct(F.array_append(acc["done"], out).alias("done"), state.alias("state"))

    def stretch(acc: Column, rows: Column) -> Column:
        """The outputs of one stretch are one element of those of the group: no append copies a long array."""
        inner = F.aggregate(rows, held(f"array<{kind}>", acc["state"]), lambda a, r: pose.let(step(a["state"], r), lambda s: append(a, s, s)))
        return pose.let(inner, lambda found: append(acc, found["done"], found["state"]))

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / STRETCH).cast("int")), lambda k: F.slice("_rows", k * STRETCH + 1, STRETCH))
    done = F.aggregate(stretches, held(f"array<array<{kind}>>", start), stretch)
    zipped = grouped.withColumn("_done", F.flatten(done["done"])).withColumn("_z", F.explode(F.arrays_zip("_rows", "_done")))
    return zipped.select(*by, *[F.col(f"_z._rows.{c}").alias(c) for c in names], F.col("_z._done").alias(into))


def _type(df: DataFrame, c: Column, name: str) -> str:
    return df.sparkSession.range(1).select(c.alias(name)).schema[name].dataType.simpleString()


def decode_deltas(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], keep: Sequence[str], initial: Sequence[float] | None = None) -> DataFrame:
    """Absolute 16-channel commands from deltas: each applies to the decoded one before it. Starts from ``initial``."""
    start = list(initial or [0.0, 0.0, 0.0, *pose.IDENTITY, 0.0] * 2)
    rows = df.withColumn("_delta", F.col(col))
    return fold(rows, by, order, [*keep, "_delta"], F.array(*[F.lit(float(x)) for x in start]), lambda s, r: pose.apply16(s, r["_delta"]), "decoded").drop("_delta")


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str], item: Column, combine: Callable[[Column, Column], Column], into: str, ranges: int | None = None) -> DataFrame:
    """Prefixes of an associative ``combine`` over each group in order, whatever its length, one output row for each row.

    Three levels, each in parallel: runs of ``STRETCH`` rows, runs of a slice of the order, slices of a group. Each level
    folds what the one below adds up to, so no task gathers more than a slice's runs; a row takes its own prefix and those
    of the run and the slice before it.
    """
    names = list(dict.fromkeys([*by, *order, *keep]))
    dealt = indexing.in_order(df.withColumn("_item", item), [*by, *order], ranges)
    number = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)) - 1
    dealt = dealt.withColumn("_k", F.floor(number / STRETCH).cast("int"))
    rows = _prefixes(dealt, [*by, "_b", "_k"], order, [n for n in names if n not in (*by, *order)], combine)
    runs = _prefixes(_totals(rows, [*by, "_b", "_k"], order), [*by, "_b"], ["_k"], [], combine)
    slices = _prefixes(_totals(runs, [*by, "_b"], ["_k"]), list(by), ["_b"], [], combine)
    before = lambda t, keys, last, name: t.select(*keys, (F.col(last) + 1).alias(last), F.col("_prefix").alias(name))
    met = rows.withColumnRenamed("_prefix", "_own")
    met = met.join(before(runs, [*by, "_b"], "_k", "_run"), [*by, "_b", "_k"], "left")
    places = slices.withColumn("_next", F.lead("_b").over(Window.partitionBy(*by).orderBy("_b"))).where("_next is not null")
    met = met.join(places.select(*by, F.col("_next").alias("_b"), F.col("_prefix").alias("_slice")), [*by, "_b"], "left")
    after = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).otherwise(combine(F.col(a), F.col(b)))
    return met.withColumn("_own", after("_run", "_own")).withColumn(into, after("_slice", "_own")).select(*names, into)


def _prefixes(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str], combine: Callable[[Column, Column], Column]) -> DataFrame:
    none = F.lit(None).cast(df.schema["_item"].dataType)
    step = lambda s, r: F.when(s.isNull(), r["_item"]).otherwise(combine(s, r["_item"]))
    return fold(df, by, order, [*keep, "_item"], none, step, "_prefix").drop("_item")


def _totals(prefixes: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return prefixes.groupBy(*by).agg(F.max_by("_prefix", F.struct(*order)).alias("_item"))


def decode_long(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], keep: Sequence[str], ranges: int | None = None) -> DataFrame:
    """:func:`decode_deltas` from the identity for series of any length: poses compose associatively."""
    start = F.array(*[F.lit(float(x)) for x in [0.0, 0.0, 0.0, *pose.IDENTITY, 0.0] * 2])
    return scan(df, by, order, keep, pose.apply16(start, F.col(col)), pose.apply16, "decoded", ranges)


def continuous_signs(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Flips quaternions so that each is on the side of the corrected one before it.

    The sign is the parity of negative products of neighbours since the last product of zero, which resets it.
    """
    w = ordered(by, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_d", F.coalesce(pose.dot(F.lag(col).over(w), F.col(col)), F.lit(0.0)))
    d = d.withColumn("_reset", F.sum((F.col("_d") == 0).cast("int")).over(run))
    inner = Window.partitionBy(*by, "_reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    odd = F.sum((F.col("_d") < 0).cast("int")).over(inner) % 2 == 1
    return d.withColumn(col, F.when(odd, pose.scale(F.col(col), -1)).otherwise(F.col(col))).drop("_d", "_reset")


def rising_edges(df: DataFrame, col: str, threshold: float, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """True where the value reaches the threshold and the one before did not; never on the first row."""
    before = F.lag(col).over(ordered(by, order))
    return df.withColumn(into, F.coalesce((F.col(col) >= threshold) & (before < threshold), F.lit(False)))


def next_marked(df: DataFrame, mark: str, value: str, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """The value of the first marked row at or after each row; null without one."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(F.when(F.col(mark), F.col(value)), ignorenulls=True).over(w))


def running_max(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    return df.withColumn(into, F.max(col).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def schedule(df: DataFrame, duration: str, by: Sequence[str], order: Sequence[str], start: str = "starts_at", arrive: str = "arrives_at") -> DataFrame:
    """Running sums of durations: when each step starts and arrives."""
    total = F.sum(duration).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(arrive, total).withColumn(start, F.col(arrive) - F.col(duration))


def batches(df: DataFrame, size: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Consecutive batches of ``size`` rows; flags of the group's first and last batch."""
    i = F.row_number().over(ordered(by, order)) - 1
    last = F.floor((F.count(F.lit(1)).over(Window.partitionBy(*by)) - 1) / size)
    out = df.withColumn("batch_id", F.floor(i / size)).withColumn("batch_pos", (i % size).cast("long"))
    return out.withColumn("first_batch", F.col("batch_id") == 0).withColumn("last_batch", F.col("batch_id") == last)


def last_rows(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str], exact: bool = False) -> DataFrame:
    """The last ``n`` rows of each group; with ``exact`` nothing of a group that has fewer."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    out = df.withColumn("_r", F.row_number().over(w))
    if exact:
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= n).drop("_n")
    return out.where(F.col("_r") <= n).drop("_r")


def rate_gate(df: DataFrame, time: str, interval: float, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows that come at least ``interval`` after the last row that passed; the first of a group passes."""
    none = F.lit(None).cast("double")
    folded = fold(
        df,
        by,
        [time, *keep],
        [],
        F.struct(none.alias("last"), F.lit(False).alias("passed")),
        lambda s, r: pose.let(s["last"].isNull() | (r[time] - s["last"] >= interval), lambda p: F.struct(F.when(p, r[time]).otherwise(s["last"]).alias("last"), p.alias("passed"))),
        "_g",
    )
    return folded.where("_g.passed").drop("_g")


def error_trips(df: DataFrame, failed: str, limit: int, by: Sequence[str], order: Sequence[str], into: str = "tripped") -> DataFrame:
    """True where at least ``limit`` failures in a row end: islands between successes."""
    run = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_island", F.sum((~F.col(failed)).cast("int")).over(run))
    inside = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("streak", F.sum(F.col(failed).cast("int")).over(inside)).withColumn(into, F.col("streak") >= limit).drop("_island")
