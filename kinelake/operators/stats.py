"""Statistics, normalisation and objectives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.sources import shared

from .resample import finite


#: Values of a group that one buffer may hold; points and accuracy of the sketch that narrows larger groups.
HELD, POINTS, ACCURACY = 1 << 16, 128, 4096


def exact_quantiles(rows: DataFrame, by: Sequence[str], x: str, shares: Sequence[float], held: int | None = None) -> DataFrame:
    """(by, share, value): quantiles that interpolate linearly, exact for groups of any size.

    Each wanted rank is bracketed by two values. A mergeable sketch of the rows in the bracket gives a narrower one, whose
    ranks are then counted, not estimated; that is repeated until at most ``held`` rows, or one value, are left. No buffer
    holds more than a sketch or ``held`` values, and every round reads only the rows in the brackets.
    """
    held = held or HELD
    spark, keys = rows.sparkSession, list(by)
    data = rows.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null")
    wanted = spark.createDataFrame([(float(p),) for p in shares], "share double")
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    at = (F.col("n") - 1) * F.col("share")
    ends = F.explode(F.array(*[F.struct(f(at).cast("long").alias("rank"), F.lit(k).alias("end")) for k, f in enumerate((F.floor, F.ceil))])).alias("_e")
    open_ = sizes.crossJoin(F.broadcast(wanted)).select(*keys, "share", "n", "lo", "hi", ends)  # a row for each share
    targets = open_.select(*keys, "share", "n", "lo", "hi", "_e.*", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    targets = _kept(targets)
    points = [k / POINTS for k in range(POINTS + 1)]
    names, before = targets.columns, None
    while (left := targets.where(f"inside > {held} and lo < hi").agg(F.count(F.lit(1)), F.sum("inside")).first()) and left[0] and tuple(left) != before:
        before = tuple(left)
        wide = targets.where(f"inside > {held} and lo < hi")
        few = left[0] <= BRACKETS
        near = _within(data, wide, keys, few)
        sketch = near.groupBy(*keys, "share", "end").agg(F.percentile_approx("_x", points, ACCURACY).alias("p"))
        place = (F.col("rank") - F.col("below")) / F.col("inside") * POINTS
        edge = 1 + POINTS * 2 // ACCURACY
        cut = wide.join(sketch, [*keys, "share", "end"]).withColumn("_lo", F.get("p", F.greatest(F.floor(place).cast("int") - edge, F.lit(0)))).withColumn("_hi", F.get("p", F.least(F.ceil(place).cast("int") + edge, F.lit(POINTS)))).drop("p")
        counted = _within(data, cut, keys, few).groupBy(*names, "_lo", "_hi").agg(F.sum((F.col("_x") < F.col("_lo")).cast("long")).alias("_under"), F.sum(F.col("_x").between(F.col("_lo"), F.col("_hi")).cast("long")).alias("_in"))
        first, last = F.col("below") + F.col("_under"), F.col("below") + F.col("_under") + F.col("_in")
        missed_low, missed_high = F.col("rank") < first, F.col("rank") >= last  # the sketch was off: keep that side
        lo, hi = F.when(missed_low, F.col("lo")).otherwise(F.col("_lo")), F.when(missed_high, F.col("hi")).otherwise(F.col("_hi"))
        under = F.when(missed_low, F.col("below")).otherwise(first)
        inside = F.when(missed_low, F.col("_under") + F.col("_in")).when(missed_high, F.col("inside") - F.col("_under")).otherwise(F.col("_in"))
        narrowed = counted.select(*keys, "share", "n", lo.alias("lo"), hi.alias("hi"), "rank", "end", under.alias("below"), inside.alias("inside"))
        targets = _kept(targets.where(f"inside <= {held} or lo >= hi").unionByName(narrowed))
    last = targets.where("lo < hi")
    some = _within(data, last, keys, last.count() <= BRACKETS).groupBy(*names).agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    values = targets.where("lo >= hi").withColumn("v", F.col("lo")).unionByName(some.withColumn("v", F.get("_v", (F.col("rank") - F.col("below")).cast("int"))).drop("_v"))
    part = (F.first("n") - 1) * F.col("share")
    low, high = (F.max(F.when(F.col("end") == k, F.col("v"))) for k in (0, 1))
    return values.groupBy(*keys, "share").agg(low.alias("_l"), high.alias("_h"), (part - F.floor(part)).alias("_p")).select(*keys, "share", (F.col("_l") + F.col("_p") * (F.col("_h") - F.col("_l"))).alias("value"))


def _kept(targets: DataFrame) -> DataFrame:
    """Cuts the lineage of the brackets: a row for each group, share and end."""
    spark = targets.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared.folder(spark))
    return targets.checkpoint()


#: Brackets that are few enough to go to every task; with more, groups are many and rows meet them by group in a shuffle.
BRACKETS = 10_000


def _within(data: DataFrame, targets: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Rows of each target's bracket. Few brackets are broadcast, so that the rows of a large group stay where they are."""
    named = targets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    named = F.broadcast(named) if few else named
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_x").between(F.col("lo"), F.col("hi")))
    return data.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])


def channel_stats(df: DataFrame, vector: str, by: Sequence[str] = (), held: int | None = None) -> DataFrame:
    """(channel, q01, q99, min, max, mean, std, count) of each channel; quantiles interpolate linearly.

    Quantiles of groups with at most ``held`` values come with the other aggregates, from one buffer; if any group is
    larger, all come from :func:`exact_quantiles`.
    """
    each = df.select(*by, F.posexplode(vector).alias("channel", "x"))
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    aggs = [F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count")]
    if most <= (held or HELD):
        q = F.percentile("x", F.array(F.lit(0.01), F.lit(0.99)))
        return each.groupBy(*by, "channel").agg(q.alias("_q"), *aggs).withColumn("q01", F.get("_q", F.lit(0))).withColumn("q99", F.get("_q", F.lit(1))).drop("_q")
    found = exact_quantiles(each, [*by, "channel"], "x", [0.01, 0.99], held)
    wide = found.groupBy(*by, "channel").agg(F.max(F.when(F.col("share") < 0.5, F.col("value"))).alias("q01"), F.max(F.when(F.col("share") > 0.5, F.col("value"))).alias("q99"))
    return each.groupBy(*by, "channel").agg(*aggs).join(wide, [*by, "channel"], "left")


def quantile_scale(x: Column, low: Column, high: Column, limit: float | None = 1.5) -> Column:
    """To [-1, 1] between two quantiles, clipped at ``limit``."""
    y = (x - low) / (high - low + 1e-6) * 2 - 1
    return y if limit is None else F.least(F.greatest(y, F.lit(-limit)), F.lit(limit))


def quantile_unscale(y: Column, low: Column, high: Column) -> Column:
    return (y + 1) / 2 * (high - low + 1e-6) + low


def standard_scale(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + 1e-6)


def minmax_by_group(df: DataFrame, col: str, by: Sequence[str], into: str, constant: str = "one") -> DataFrame:
    """To [0, 1] inside each group; a constant series gives 1.0 ("one") or its own value clipped to [0, 1] ("clip")."""
    if constant not in ("one", "clip"):
        raise ValueError("constant must be 'one' or 'clip'")
    w = Window.partitionBy(*by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    flat = F.lit(1.0) if constant == "one" else F.least(F.greatest(F.col(col), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(into, F.when(high - low < 1e-6, flat).otherwise((F.col(col) - low) / (high - low)))


def range_spec(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, low, high, degenerate): finite range over several columns together."""
    values = F.explode(F.array(*[F.col(c).cast("double") for c in cols]))
    r = df.select(*by, values.alias("_v")).where(finite(F.col("_v"))).groupBy(*by).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    return r.withColumn("degenerate", F.col("high") - F.col("low") < 1e-6)


def fixed_range(x: Column, low: float, high: float, inverted: bool) -> Column:
    y = (F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / max(high - low, 1e-6)
    return 1 - y if inverted else y


def plot_range(df: DataFrame, col: str, by: Sequence[str], margin: float = 0.1) -> DataFrame:
    """Finite range with a margin; a constant series gets its own size, or 1 around zero."""
    r = df.where(finite(F.col(col))).groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * margin).otherwise(F.greatest(F.abs("hi") * margin, F.lit(1.0)))
    return r.select(*by, (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def masked_mean(df: DataFrame, loss: str, weight: str, mask: str, by: Sequence[str] = (), guard: str = "count") -> DataFrame:
    """Mean of loss * weight over masked rows; the divisor is at least 1 ("count") or has 1e-6 added ("epsilon")."""
    top, n = F.sum(F.col(loss) * F.col(weight) * F.col(mask).cast("double")), F.sum(F.col(mask).cast("double"))
    under = F.greatest(n, F.lit(1.0)) if guard == "count" else n + 1e-6
    return df.groupBy(*by).agg((top / under).alias("loss"))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def preference_loss(df: DataFrame, cur_w: str, cur_l: str, ref_w: str, ref_l: str, beta: float = 1.0, pro: float = 1.0, sft: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Contrastive and proximal preference objective plus the winners' own loss."""
    rw, rl = (F.col(ref_w) - F.col(cur_w)) * (beta / 2), (F.col(ref_l) - F.col(cur_l)) * (beta / 2)
    near = (log_sigmoid(rw) + log_sigmoid(-rw) + log_sigmoid(rl) + log_sigmoid(-rl)) * -0.5
    terms = df.select(*by, (near - log_sigmoid(rw - rl)).alias("p"), F.col(cur_w).alias("s"), rw.alias("rw"), rl.alias("rl"))
    out = terms.groupBy(*by).agg(F.avg("p").alias("loss_pro"), F.avg("s").alias("loss_sft"), F.avg("rw").alias("reward_winner"), F.avg("rl").alias("reward_loser"))
    return out.withColumn("loss", F.col("loss_pro") * pro + F.col("loss_sft") * sft)


def noise_schedule(spark, steps: int = 1000, shift: float = 1.0, sigma_min: float = 0.0, sigma_max: float = 1.0, train_steps: int = 1000, exponential: float | None = None, terminal: float | None = None, extra: bool = True) -> DataFrame:
    """(step, sigma, timestep, weight): noise levels from high to low, shifted, and bell-shaped training weights."""
    pieces = steps if extra else steps - 1
    base = F.lit(sigma_max) + F.col("step") * ((sigma_min - sigma_max) / pieces)
    s = spark.range(steps).select(F.col("id").alias("step")).withColumn("sigma", base.cast("double"))
    if exponential is not None:
        e = F.exp(F.lit(float(exponential)))
        s = s.withColumn("sigma", e / (e + (1 / F.col("sigma") - 1)))
    else:
        s = s.withColumn("sigma", F.lit(float(shift)) * F.col("sigma") / (1 + (shift - 1) * F.col("sigma")))
    whole = Window.partitionBy()  # a fixed number of steps, not of rows
    if terminal is not None:
        s = s.withColumn("sigma", 1 - (1 - F.col("sigma")) / (F.max(1 - F.col("sigma")).over(whole) / (1 - terminal)))
    s = s.withColumn("timestep", F.col("sigma") * train_steps)
    y = F.exp(-2 * F.pow((F.col("timestep") - steps / 2) / steps, F.lit(2.0)))
    s = s.withColumn("_y", y).withColumn("_y", F.col("_y") - F.min("_y").over(whole))
    return s.withColumn("weight", F.col("_y") * (steps / F.sum("_y").over(whole))).drop("_y")


def nearest_step(rows: DataFrame, schedule: DataFrame, want: str, into: str, block: int = 32) -> DataFrame:
    """Adds ``into``: the (timestep, step, sigma) of the schedule nearest to the wanted time; the first step wins a tie.

    The schedule, one row for each step, is broadcast as one row of blocks in the order of time. A row looks for its place
    among the blocks' first times, then in one block, and compares its neighbours only; one below the schedule, or without
    a time, meets all entries. Rows are neither moved nor grouped.
    """
    firsts = schedule.groupBy("timestep").agg(F.min(F.struct("step", "sigma")).alias("_f"))
    table = firsts.agg(F.array_sort(F.collect_list(F.struct("timestep", "_f.step", "_f.sigma"))).alias("_all"))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(block))
    table = table.select("_all", F.transform(starts, lambda k: F.element_at("_all", k)["timestep"]).alias("_heads"), F.transform(starts, lambda k: F.slice("_all", k, block)).alias("_blocks"))
    wanted = F.col(want)
    below = lambda entries, time: F.size(F.filter(entries, lambda x: time(x) <= wanted))
    at = F.greatest(below(F.col("_heads"), lambda x: x) - 1, F.lit(0))
    place = at * block + below(F.get("_blocks", at), lambda x: x["timestep"])
    compared = F.when(wanted >= F.get("_heads", F.lit(0)), F.slice("_all", F.greatest(place, F.lit(1)), 2)).otherwise(F.col("_all"))
    best = F.array_min(F.transform(compared, lambda x: F.struct(F.abs(x["timestep"] - wanted).alias("d"), x["step"].alias("step"), x["timestep"].alias("timestep"), x["sigma"].alias("sigma"))))
    return rows.join(F.broadcast(table)).withColumn(into, best).drop("_all", "_heads", "_blocks")


def learning_rate(step: Column, total: int, warmup: int, peak: float, low: float = 0.0) -> Column:
    """Linear warm-up, then a cosine down to ``low``."""
    down = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(low + (peak - low) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * down)))


def softmax_ensemble(df: DataFrame, by: Sequence[str], newest: str, vector: str, alpha: float) -> DataFrame:
    """Mean of a group's predictions weighted by exp(alpha * cosine to the newest one)."""
    first = df.groupBy(*by).agg(F.max_by(vector, newest).alias("_ref"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v, r = F.col(vector), F.col("_ref")
    cos = dot(v, r) / (F.sqrt(dot(v, v)) * F.sqrt(dot(r, r)) + 1e-7)
    w = df.join(first, list(by)).withColumn("_w", F.exp(cos * alpha)).select(*by, "_w", F.posexplode(vector).alias("channel", "x"))
    return w.groupBy(*by, "channel").agg((F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("value"))


def carry_forward(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """The last valid value up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(col, ignorenulls=True).over(w))
