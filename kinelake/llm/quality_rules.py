"""Quality rules as weak supervision (native: DataFrame functions only).

Each rule votes good, bad or abstains; rules are strict, so a good document may well get a bad vote. A document is good or
bad, and the rules vote independently given which. Expectation-maximisation over the counts of vote patterns (at most
3 ** rules of them, whatever the number of documents) estimates how often each rule votes good, bad or not at all on
either kind, and the share of good documents. It covers all documents that the base rules leave to it. A document stays
if it passes the base rules and its posterior probability of being good is at least a threshold, so votes are weighed
against each other: a bad vote of a rule that often errs is outvoted. The priors count as ten documents.

Defined results: words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
return; a null or blank text has none, all its counts are 0 and it fails the base rules; repeated rows each get their
own row; an empty table gives an empty result; further columns are ignored and may have any name.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch

#: The blanks as an SQL literal.
BLANKS_SQL = " \\t\\n\\u000b\\u000c\\r"
SYMBOLS = "#*$%&|<>"
#: Characters that are counted: the marks of ASCII and its capitals.
COUNTED = "!-/:-@\\[-`{-~A-Z"
#: Prior counts of (bad, good, no) votes on good and on bad documents, and of good and bad documents.
GOOD_VOTES, BAD_VOTES, KINDS = (0.5, 8.0, 1.5), (3.0, 4.5, 2.5), (8.0, 2.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the features; neither holds: the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "100 * n_symbols > 5 * n_words", "100 * n_symbols <= n_words"),
    Rule("marks", "100 * n_marks > 12 * word_chars", "100 * n_marks <= 6 * word_chars"),
    Rule("capitals", "100 * n_upper > 10 * word_chars", "100 * n_upper <= 5 * word_chars"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("lines", "100 * n_dup_lines > 20 * n_lines", "n_dup_lines = 0"),
    Rule("shouting", "100 * n_exclaim > 5 * n_words", "100 * n_exclaim <= n_words"),
    Rule("word_length", "word_chars < 4 * n_words or word_chars > 7 * n_words", "10 * word_chars between 43 * n_words and 60 * n_words"),
    Rule("sentences", "n_words > 30 * n_stops or n_words < 4 * n_stops", "n_words between 6 * n_stops and 20 * n_stops"),
)


def _windows(words: Column) -> Column:
    """Sorted (hash, place) of each 3-word window."""
    places = F.sequence(F.lit(0), F.size(words) - 3)
    pairs = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= 4, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def with_counts(docs: DataFrame, text_col: str = "text", into: str = "_q") -> DataFrame:
    """Adds the struct column ``into`` with the counts that the rules use."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_b", F.expr(f"btrim(_t, '{BLANKS_SQL}')"))
    out = out.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", "[ \\x09-\\x0D]+")))
    out = out.withColumn("_l", F.expr(f"filter(split(_t, '\\n', -1), l -> btrim(l, '{BLANKS_SQL}') != '')"))
    out = out.withColumn("_s", _windows(F.col("_w")))
    flagged = "filter(sequence(0, size(_s) - 1), k -> (k > 0 and get(_s, k).h = get(_s, k - 1).h) or (k + 1 < size(_s) and get(_s, k).h = get(_s, k + 1).h))"
    out = out.withColumn("_p", F.expr(f"if(size(_s) = 0, cast(array() as array<int>), sort_array(transform({flagged}, k -> get(_s, k).i)))"))
    covered = "if(size(_p) = 0, 0L, aggregate(sequence(0, size(_p) - 1), 0L, (a, k) -> a + if(k + 1 < size(_p), least(3, get(_p, k + 1) - get(_p, k)), 3)))"
    # One pass leaves only the few characters that are counted.
    out = out.withColumn("_x", F.regexp_replace("_t", f"[^{COUNTED}]+", ""))
    less = lambda chars: f"cast(length(_x) - length(translate(_x, '{chars}', '')) as bigint)"
    counts = {
        "n_words": "cast(size(_w) as bigint)",
        "word_chars": "cast(length(array_join(_w, '')) as bigint)",
        "n_symbols": less(SYMBOLS),
        "n_dup_lines": "cast(size(_l) - size(array_distinct(_l)) as bigint)",
        "n_repeat_words": f"cast({covered} as bigint)",
        "n_lines": "cast(size(_l) as bigint)",
        "n_upper": less(UPPER),
        "n_marks": f"cast(length(translate(_x, '{UPPER}', '')) as bigint)",
        "n_exclaim": less("!"),
        "n_stops": less(".!?"),
    }
    made = ", ".join(f"'{k}', {v}" for k, v in counts.items())
    # explode keeps the optimiser from copying the counts into every use of them.
    return out.withColumn(into, F.expr(f"explode(array(named_struct({made})))")).drop("_t", "_b", "_w", "_l", "_s", "_p", "_x")


def votes(counts: str = "_q") -> dict[str, Column]:
    """Rule name to its vote: 1 good, 0 bad, null abstains."""
    at = lambda sql: F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"{counts}.\1", sql))
    return {r.name: F.when(at(r.bad), 0).when(at(r.good), 1) for r in RULES}


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and for each rule the probabilities of a vote of bad, good and none on either kind."""

    prior: float
    good: dict[str, tuple[float, float, float]]
    bad: dict[str, tuple[float, float, float]]
    converged: bool = True

    def weights(self, name: str) -> tuple[float, float, float]:
        """The log odds (good : bad) that a vote of bad, good or none adds."""
        return tuple(math.log(g / b) for g, b in zip(self.good[name], self.bad[name]))

    def posterior(self, vote: dict[str, Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name in self.good:
            bad, good, none = self.weights(name)
            odds = odds + F.when(vote[name] == 0, bad).when(vote[name] == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: Sequence[tuple[Sequence[int | None], int]], names: Sequence[str], rounds: int = 20_000, tolerance: float = 1e-9) -> LabelModel:
    """EM over (votes, number of documents) until no estimate moves by ``tolerance``; a warning if ``rounds`` end it."""
    place = {0: 0, 1: 1, None: 2}
    votes = np.array([[place[v] for v in vs] for vs, _ in patterns], np.int64).reshape(len(patterns), len(names))
    cast = (votes[:, :, None] == np.arange(3)).astype(float)  # patterns, rules, votes
    count = np.array([n for _, n in patterns], float)
    priors = np.array([GOOD_VOTES, BAD_VOTES])
    theta = np.repeat((priors / priors.sum(axis=1, keepdims=True))[:, None], len(names), axis=1)  # kinds, rules, votes
    share = KINDS[0] / sum(KINDS)
    converged = False
    for _ in range(rounds):
        odds = math.log(share / (1 - share)) + np.einsum("prv,rv->p", cast, np.log(theta[0] / theta[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        seen = np.stack([np.einsum("p,prv->rv", w, cast) for w in (p * count, (1 - p) * count)]) + priors[:, None]
        before, theta = theta, seen / seen.sum(axis=2, keepdims=True)
        last, share = share, float((p @ count + KINDS[0]) / (count.sum() + sum(KINDS)))
        if max(float(np.abs(theta - before).max(initial=0)), abs(share - last)) < tolerance:
            converged = True
            break
    if not converged:
        logging.getLogger(__name__).warning("the label model still moved after %d rounds", rounds)
    if theta[0, :, 1].sum() + theta[1, :, 0].sum() < theta[1, :, 1].sum() + theta[0, :, 0].sum():  # the good kind is the one that rules call good
        theta, share = theta[::-1], 1 - share
    good, bad = ({n: tuple(float(x) for x in row) for n, row in zip(names, kind)} for kind in theta)
    return LabelModel(share, good, bad, converged)


def learn(counted: DataFrame, counts: str = "_q") -> LabelModel:
    """Fits the label model on the vote patterns of all documents that pass the base rules.

    What reaches the driver is at most 3 ** rules rows.
    """
    vote = votes(counts)
    rows = counted.where(~F.expr(BASE_FAILED.format(counts))).groupBy(*[v.alias(k) for k, v in vote.items()]).count().collect()
    names = list(vote)
    return fit_label_model(sorted(((tuple(r[k] for k in names), r["count"]) for r in rows), key=str), names)


BASE_FAILED = "{0}.n_words < 50 or 100 * {0}.n_repeat_words > 50 * {0}.n_words"


def verdict(counted: DataFrame, model: LabelModel, counts: str = "_q", threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, p_good and kept."""
    out = counted.withColumn("base_failed", F.expr(BASE_FAILED.format(counts))).withColumn("p_good", model.posterior(votes(counts)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five counts, base_failed, kept, p_good) of each row."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    counted = Scratch(docs.sparkSession, "quality-rules").put("counts", with_counts(narrow, "_text").drop("_text"))
    judged = verdict(counted, learn(counted))
    return judged.select(F.col("_id").alias(id_col), *[F.col(f"_q.{c}").alias(c) for c in COUNTS], "base_failed", "kept", "p_good")


def drop_low_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are counted once and written with their counts."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = docs.select(row, F.col(f"`{text_col}`").alias("_text"))
    counted = Scratch(docs.sparkSession, "quality-rules").put("rows", with_counts(held, "_text").drop("_text"))
    return verdict(counted, learn(counted)).where("kept").select("_row.*")
