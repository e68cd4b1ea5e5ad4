"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed: each word, and each run of one to three word shapes (capitals, small letters, digits, other
characters; a word equal to the one before it has a shape of its own). Each is scaled by the log ratio of its smoothed
counts in the two classes, then dual coordinate descent fits a hinge loss. Executors turn texts into indicators; only
those of a bounded sample of labelled rows (``sample``, by hash order of the id) reach the driver, where the fit runs.
A logistic curve fitted to the margins of rows left out of their own fit gives the score.

Defined results: a null or blank text has no indicators and gets the score of the intercept; a null label is no label; of
several labels of one id the greatest counts; without labels of both classes the score is the share of label 1 (0.5
without any); a null id is never learned from and counts as held out; repeated rows each get their own row; an empty
table gives an empty result; further columns are ignored and may have any name.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .bpe import out_batches

#: Size of the indicator space, and most labelled rows that the fit uses.
DIMS, SAMPLE = 1 << 20, 5000
WORDS_KEPT = 150_000
#: Codes of a repeated word's shape and of the text's edges.
AGAIN, EDGE = 0x9E3779B1, 0x85EBCA77


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits become A, a and 0; other characters stay, repeated ones once."""
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class _Codes(dict):
    """Word -> hash of its lower-case letters (high half) and of its shape (low half)."""

    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        code = self[word] = xxh32_intdigest(word.lower().encode()) << 32 | xxh32_intdigest(shape(word).encode(), 1)
        return code


_codes = _Codes()


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct indicators of a whole text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint32)
    code = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    word, form = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    form[1:][word[1:] == word[:-1]] = AGAIN
    form = np.concatenate(([np.uint64(EDGE)], form, [np.uint64(EDGE)]))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = form[:-1] * a + form[1:] * b
    three = two[:-1] * c + form[2:] * a
    parts = [word * a + np.uint64(1), form * b + np.uint64(2), two + np.uint64(3), three + np.uint64(4)]
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(29)
    mixed *= b
    return np.unique((mixed >> np.uint64(64 - 20)).astype(np.uint32) & np.uint32(DIMS - 1))


@dataclass
class Model:
    """Log-count ratios, the weights of indicators times their ratios, and the score's curve."""

    ratios: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        """Texts are scaled to unit length, so that long ones don't outweigh short ones."""
        if not len(found):
            return self.intercept
        v = self.ratios[found]
        return float(self.weights[found].sum()) / max(1e-6, float(np.sqrt(v @ v))) + self.intercept

    def score(self, found: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(DIMS, alpha, np.float64) for _ in range(2)]
    for found, y in zip(rows, labels):
        counts[int(y)][found] += 1
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    return (np.log(counts[1] / (n[1] + 2 * alpha)) - np.log(counts[0] / (n[0] + 2 * alpha))).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: tuple[float, float], epochs: int = 1000, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss, L2 penalty: one dual coordinate for each row, each step exact, until no step moves a margin by a hundredth."""
    w, bias = np.zeros(DIMS, np.float32), 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i], values[i]
            slack = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost[int(labels[i])])
            step = (new - alpha[i]) * y[i]
            if step:
                moved = max(moved, abs(step) * square[i])
                alpha[i] = new
                w[at] += np.float32(step) * v
                bias += step
        if moved < 1e-2:
            break
    else:
        logging.getLogger(__name__).warning("the fit still moved after %d epochs", epochs)
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, folds: int = 3) -> Model:
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99)
        none = np.zeros(DIMS, np.float32)
        return Model(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))

    def train(keep: np.ndarray) -> Model:
        own, y = [rows[i] for i in keep], labels[keep]
        ratios = log_count_ratios(own, y)
        values = [v / max(1e-6, float(np.sqrt(v @ v))) for v in (ratios[r] for r in own)]
        weight = len(y) / (2 * np.maximum(1, np.bincount(y.astype(int), minlength=2)))  # the classes weigh the same
        w, bias = dual_descent(own, values, y, (cost * weight[0], cost * weight[1]))
        return Model(ratios, w * ratios, bias)

    fold = np.arange(len(rows)) % folds
    margins = np.zeros(len(rows))
    for k in range(folds):
        part = train(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margins[i] = part.margin(rows[i])
    model = train(np.arange(len(rows)))
    model.slope, model.shift = _curve(margins, labels)
    return model


def _curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic regression of the label on the margin (Newton steps, smoothed targets)."""
    n1, n0 = (labels > 0).sum(), (labels == 0).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)])
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        grad = x @ (p - target) + 1e-3 * beta
        hess = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows whose crc32 remainder is not ``held``."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(remainder("id", folds) != held).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(20)), "id").limit(sample)  # at most ``sample`` rows: small enough to broadcast
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), y.as_py(), indicators(t.as_py()).tobytes()) for b in batches for i, y, t in zip(*(b.column(k) for k in range(3))))
        yield from out_batches(rows, schema)

    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(run, "id long, y int, found binary")
    got = sorted((r["id"], int(r["y"] > 0), bytes(r["found"])) for r in rows.collect())
    return fit([np.frombuffer(f, np.uint32) for _, _, f in got], np.array([y for _, y, _ in got], np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A column with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by DIMS

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(indicators(t)) for t in texts], dtype="float64")

    return scored(F.col(f"`{text_col}`").cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    model = learn(docs, labels, id_col, text_col, folds=folds, held=held)
    out = docs.select(F.col(f"`{id_col}`"), F.coalesce(remainder(id_col, folds) == held, F.lit(True)).alias("held_out"), score(docs, model, id_col, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, train: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns. Learns from ``train``."""
    model = learn(train, labels, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = docs.select(row, score(docs, model, id_col, text_col).alias("_score"))
    return scored.where(F.col("_score") >= threshold).select("_row.*")
