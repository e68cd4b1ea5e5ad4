"""Language identification by multilingual mixture inference.

Counts of hashed letter n-grams (one to three letters, words padded by blanks) give each language a smoothed
distribution. A document is a mixture of languages: expectation-maximisation finds the proportions that make its n-grams
likeliest, and languages leave the set one by one while the likelihood that they add is below a penalty of ``PENALTY``
per language and doubling of the n-grams. The prediction is the language of the largest proportion, the score that
proportion.

Counting covers all learnable documents; a task adds up its own counts before the shuffle. The model is a written table,
one row for each language, dealt into blocks of about ``BLOCK`` languages, and nothing of it passes through the driver. A
task takes its texts block by block: the languages that stand after one block compete with those of the next. So memory
is bounded by a block, whatever the number of languages; a language that an earlier set made superfluous does not return.

Defined results: a null text or one without a letter gives ``und`` with score 0; documents with a null language or a null
id are not learned from; without any learnable document every prediction is ``und``; of equal proportions the
alphabetically first language wins; repeated rows each get their own row; an empty table gives an empty result; columns
other than id, text and language are ignored and may have any name.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .quality_classifier import remainder

#: Hash buckets of the n-grams; smoothing; penalty of a language in nats, times the logarithm of the number of n-grams.
BUCKETS, SMOOTH, PENALTY = 1 << 15, 0.5, 1.0
#: Most EM rounds for one set of languages, after which a warning is logged.
ROUNDS = 1000
#: Languages of one block, about (16 MB of numbers); languages whose counts a task holds at a time; texts that meet a block at a time.
BLOCK, HELD, TEXTS = 64, 256, 256
#: Characters that are counted at a time: a long text goes in parts that overlap.
SPAN = 1 << 20
_not_letter = re.compile(r"[\W\d_]+")


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 15)).astype(np.int64)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts by bucket over a whole text; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), SPAN):
        part = _not_letter.sub(" ", text[max(0, at - 2) : at + SPAN].lower())
        c = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        blank = c == 32
        two = c[:-1] << np.uint64(21) | c[1:]
        three = two[:-1] << np.uint64(21) | c[2:]
        # An n-gram with a blank inside joins two words: only blanks at the edges count.
        one = c[~blank]
        two = two[~(blank[:-1] & blank[1:])]
        three = three[~blank[1:-1]]
        for k, grams in enumerate((one, two, three)):
            total += np.bincount(_hash(grams * np.uint64(4) + np.uint64(k)), minlength=BUCKETS)
    return total


def chosen_shares(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The proportions of the languages (columns of ``p``) that the penalty leaves, 0 for others. Of equals the first stays.

    While many languages have next to nothing, the lesser half goes at once, if all of it is worth less than one penalty.
    """
    total = n.sum()
    penalty = PENALTY * np.log(total + 1)
    chosen = np.arange(p.shape[1])
    share, fit = _em(p, n, total)
    halves = True
    while len(chosen) > 1:
        order = np.argsort(-share, kind="stable")
        rest = np.sort(order[: (len(order) + 1) // 2 if halves else -1])
        # From what the larger set had found, evened out a little: no language is out of the race.
        begin = 0.9 * share[rest] / max(share[rest].sum(), 1e-300) + 0.1 / len(rest)
        fewer, worse = _em(p[:, chosen[rest]], n, total, begin)
        if fit - worse <= penalty:
            chosen, share, fit = chosen[rest], fewer, worse
        elif halves:
            halves = False
        else:
            break
    out = np.zeros(p.shape[1])
    out[chosen] = share
    return out


@dataclass
class LanguageModel:
    """Languages in alphabetical order, and their n-gram distributions (buckets by languages)."""

    languages: list[str]
    probability: np.ndarray

    def mixture(self, counts: np.ndarray) -> np.ndarray:
        """The proportions of the languages that the penalty leaves, 0 for others."""
        found = np.flatnonzero(counts)
        return chosen_shares(self.probability[found], counts[found].astype(np.float64))


class Contest:
    """One text's n-grams, and the languages that still stand for it after the blocks that it has met."""

    def __init__(self, counts: np.ndarray):
        self.found = np.flatnonzero(counts)
        self.n = counts[self.found].astype(np.float64)
        self.languages: list[str] = []
        self.p = np.zeros((len(self.found), 0))
        self.share = np.zeros(0)

    def meet(self, block: LanguageModel) -> None:
        names = self.languages + block.languages
        order = sorted(range(len(names)), key=names.__getitem__)
        p = np.hstack([self.p, block.probability[self.found]])[:, order]
        share = chosen_shares(p, self.n)
        stay = np.flatnonzero(share)
        self.languages, self.p, self.share = [names[order[k]] for k in stay], p[:, stay], share[stay]

    def winner(self) -> tuple[str, float]:
        if not self.languages:
            return "und", 0.0
        best = int(np.argmax(self.share))
        return self.languages[best], float(min(1.0, self.share[best]))


class Blocks:
    """The blocks of a written model, read one at a time; the one of a model with a single block is kept."""

    def __init__(self, uri: str):
        self.uri = uri
        self.kept: list[LanguageModel] | None = None

    def __iter__(self) -> Iterator[LanguageModel]:
        if self.kept is not None:
            yield from self.kept
            return
        files, root = fs.FileSystem.from_uri(self.uri)
        parts: dict[str, list[str]] = {}
        for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.path.endswith(".parquet"):
                parts.setdefault(f.path.rsplit("/", 2)[1], []).append(f.path)
        for folder in sorted(parts):
            block = self._read(files, sorted(parts[folder]))
            if len(parts) == 1:
                self.kept = [block]
            yield block
        if not parts:
            self.kept = []

    @staticmethod
    def _read(files: fs.FileSystem, paths: list[str]) -> LanguageModel:
        rows = pa.concat_tables([pq.read_table(p, filesystem=files, partitioning=None) for p in paths]).sort_by("lang")
        counts = np.full((BUCKETS, rows.num_rows), SMOOTH)
        for k, grams in enumerate(rows.column("grams")):
            own = grams.values
            counts[own.field("bucket").to_numpy(), k] += own.field("n").to_numpy()
        return LanguageModel(rows.column("lang").to_pylist(), counts / counts.sum(axis=0, keepdims=True))


def _em(p: np.ndarray, n: np.ndarray, total: float, begin: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of one set of languages. The likelihood has one maximum, which any start leads to."""
    k = p.shape[1]
    if k == 1:
        return np.ones(1), float(n @ np.log(p[:, 0]))
    share = np.full(k, 1 / k) if begin is None else begin
    for _ in range(ROUNDS):
        mixed = p @ share
        nxt = share * ((n / mixed) @ p) / total
        done = np.abs(nxt - share).max() < 1e-4
        share = nxt
        if done:
            break
    else:
        logging.getLogger(__name__).warning("a mixture of %d languages still moved after %d rounds", k, ROUNDS)
    return share, float(n @ np.log(p @ share))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> str:
    """Counts n-grams by language over all documents with a language whose crc32 remainder is not ``held``.

    Returns the folder of the model: (lang, grams) by block, read with :class:`Blocks`.
    """
    rows = docs.where(F.coalesce(remainder(id_col, folds) != held, F.lit(False)) & F.col(f"`{lang_col}`").isNotNull())
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def drained(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=schema)
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        with np.errstate(over="ignore"):
            for b in batches:
                for lang, text in zip(b.column(0), b.column(1)):
                    counts, name = gram_counts(text.as_py()), lang.as_py()
                    if counts is None:
                        continue
                    if name not in sums and len(sums) == HELD:
                        yield from drained(sums)
                    sums[name] = sums[name] + counts if name in sums else counts
        yield from drained(sums)

    summed = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams"))  # at most BUCKETS entries
    blocks = -(-rows.select("lang").distinct().count() // BLOCK)
    path = Scratch(docs.sparkSession, "languages").path("model")
    model.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(max(1, blocks)))).repartition("block").write.partitionBy("block").parquet(path)
    return path


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score) of each row."""
    path = learn(docs, id_col, text_col, lang_col, folds, held)

    def answered(texts: pd.Series, blocks: Blocks) -> list[tuple[str, float]]:
        counts = map(gram_counts, texts)
        met = [None if c is None else Contest(c) for c in counts]
        for block in blocks:
            for contest in met:
                if contest is not None:
                    contest.meet(block)
        return [("und", 0.0) if contest is None else contest.winner() for contest in met]

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(path)
        with np.errstate(over="ignore"):
            for texts in batches:
                rows = [row for at in range(0, len(texts), TEXTS) for row in answered(texts.iloc[at : at + TEXTS], blocks)]
                yield pd.DataFrame(rows, columns=["lang", "score"])

    out = docs.select(F.col(f"`{id_col}`"), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), predicted(F.col(f"`{text_col}`").cast("string")).alias("_p"))
    return out.select(id_col, "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
