"""Periodic runs of words in each text, found through the text's suffix tree (Stoye and Gusfield).

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; runs shorter than
``least`` words or than ``copies`` periods are not reported. The steps, for a block of texts at once:

* :class:`SuffixTree` holds the tree as arrays: leaves in suffix order (prefix doubling over the places that are not yet
  told apart), and each internal node as its depth and its range of leaves, from the longest common prefixes of neighbours.
* :meth:`SuffixTree.branching_repeats` walks the leaf lists of all children of a node but its largest one. A leaf i of a
  node of depth d is half of a branching tandem repeat if i + d or i - d is a leaf of the node and the word behind the
  repeat breaks the period. Each leaf is visited once for each halving of its node, so n log n times in all.
* :func:`maximal_runs` rotates each repeat to the left while the word before continues the period. Repeats with one end
  are merged: those inside the run of a shorter period are multiples of it.

Every text is one row's own business: nothing is shuffled, and a text's tree never leaves its task.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null text has no words; a text without runs has zero runs and the
digest of nothing; of two best runs the one with the smaller start, then the smaller period, is named; repeated rows and
null ids each give their own row; an empty table gives an empty result; columns other than id and text are ignored and
may have any name; a text of a million words, all of them equal or none, is one block of its own.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of texts that share one set of arrays, leaves that are looked up at once, and single rotations before galloping.
BLOCK_WORDS, LEAVES_AT_ONCE, ROTATIONS = 1 << 18, 1 << 19, 16
#: Rounds of pointer jumping before the tree of minima is used.
JUMPS = 16
SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a positive value the nearest place before it with a smaller one; the first value is zero.

    Places point to the one before and then take over the pointers of places that are not smaller. The few that have far to
    go find theirs in a tree of minima.
    """
    to = np.arange(len(values)) - 1
    left = np.flatnonzero(values > 0)
    for _ in range(JUMPS):
        left = left[values[to[left]] >= values[left]]
        if not len(left):
            return to
        to[left] = to[to[left]]
    minima = [values]
    while len(minima[-1]) > 1:
        low = minima[-1]
        minima.append(np.minimum(low[::2], np.append(low[1::2], low[-1])[: -(-len(low) // 2)]))
    value, at, height, found = values[left], left.copy(), np.zeros(len(left), np.int64), np.zeros(len(left), bool)
    for k, low in enumerate(minima):  # up: whole nodes before the place
        here = np.flatnonzero(~found & (at & 1 == 1))
        at[here] -= 1
        hit = here[low[at[here]] < value[here]]
        found[hit], height[hit] = True, k
        at[~found] >>= 1
    for k in range(len(minima) - 1, 0, -1):  # down: to the last smaller one
        here = np.flatnonzero(height >= k)
        right = 2 * at[here] + 1
        inside = right < len(minima[k - 1])
        at[here] = right - 1 + (inside & (minima[k - 1][np.where(inside, right, 0)] < value[here]))
    to[left] = at
    return to


class SuffixTree:
    """The suffix trees of several texts over one array of word numbers; no node spans two texts."""

    def __init__(self, words: np.ndarray, lengths: Sequence[int]):
        self.words = words
        lengths = np.asarray(lengths, np.int64)
        bounds = np.cumsum(lengths)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.ends = bounds[self.text] if len(words) else np.zeros(0, np.int64)
        self.begins = self.ends - lengths[self.text] if len(words) else self.ends
        self._sort()

    def _sort(self) -> None:
        """Sets ``order`` (leaves), ``rank`` (its inverse) and ``lcp`` (words shared with the leaf before)."""
        words, ends, n = self.words, self.ends, len(self.words)
        self.lcp = np.zeros(n, np.int64)
        key = self.text * (int(words.max()) + 1 if n else 1) + words
        order = np.argsort(key, kind="stable")
        first = np.ones(n, bool)  # of the leaves that share the first h words
        first[1:] = key[order[1:]] != key[order[:-1]]
        heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = heads
        levels, h = [rank.astype(np.int32)], 1
        while True:
            open_ = np.flatnonzero(~first | np.append(~first[1:], False)[:n])
            if not len(open_):
                break
            at = order[open_]
            after = at + h
            inside = after < ends[at]
            key = heads[open_] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[open_] = at
            slots = open_[1:]
            split = slots[(key[1:] != key[:-1]) & ~first[slots]]
            self.lcp[split] = self._shared(order[split - 1], order[split], h, levels)
            first[split] = True
            heads[open_] = np.maximum.accumulate(np.where(first[open_], open_, 0))
            rank[at] = heads[open_]
            levels.append(rank.astype(np.int32))
            h *= 2
        self.order, self.rank = order, rank

    def _shared(self, a: np.ndarray, b: np.ndarray, h: int, levels: list[np.ndarray]) -> np.ndarray:
        """How many words the suffixes at a and b share, where it is at least h and less than 2 h."""
        n = np.full(len(a), h)
        for level in reversed(levels[:-1]):
            h //= 2
            x, y = a + n, b + n
            same = np.flatnonzero((x < self.ends[a]) & (y < self.ends[b]))
            same = same[level[x[same]] == level[y[same]]]
            n[same] += h
        return n

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Internal nodes but the root: (depth, first leaf, behind the last leaf), and their children as (node, first leaf);
        a child ends where the next one of its node begins."""
        cuts = np.flatnonzero(self.lcp > 0)
        behind = len(self.lcp) - smaller_before(np.append(0, self.lcp[::-1]))[::-1][:-1]  # the same, seen from the end
        low, high, depth = smaller_before(self.lcp)[cuts], behind[cuts], self.lcp[cuts]
        by = np.argsort(low * (int(depth.max()) + 1 if len(depth) else 1) + depth, kind="stable")
        cuts, low, high, depth = cuts[by], low[by], high[by], depth[by]
        new = np.ones(len(cuts), bool)
        new[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
        node = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        child_node = np.insert(node, heads, node[heads])
        return depth[heads], low[heads], high[heads], child_node, np.insert(cuts, heads, low[heads])

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of every branching tandem repeat."""
        depth, low, high, node, begin = self.nodes()
        if not len(depth):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        end = np.append(begin[1:], 0)
        end[np.append(heads[1:], len(node)) - 1] = high
        size = end - begin
        large = np.flatnonzero(size == np.maximum.reduceat(size, heads)[node])
        small = np.ones(len(node), bool)
        small[large[np.diff(node[large], prepend=-1) > 0]] = False  # the first of the largest
        node, begin, size = node[small], begin[small], size[small]
        total, found = np.cumsum(size), []
        at = 0
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LEAVES_AT_ONCE, "right")))
            n = size[at:to]
            of = np.repeat(node[at:to], n)
            leaf = self.order[np.repeat(begin[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found += self._halves(leaf, depth[of], low[of], high[of])
            at = to
        place, period = (np.concatenate(x) for x in zip(*found))
        return place, period

    def _halves(self, leaf: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, inside in ((leaf, leaf + d < self.ends[leaf]), (leaf - d, leaf - d >= self.begins[leaf])):
            other = np.where(inside, first + d if first is leaf else first, 0)
            slot = self.rank[other]
            ok = np.flatnonzero(inside & (slot >= low) & (slot < high))
            i, q = first[ok], d[ok]
            behind = i + 2 * q
            last = behind >= self.ends[i]
            breaks = last | (self.words[np.where(last, 0, behind)] != self.words[i + q])
            yield i[breaks], q[breaks]


def _rotations(words: np.ndarray, begins: np.ndarray, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How often each repeat can be rotated to the left."""
    n = np.zeros(len(place), np.int64)
    live = np.arange(len(place))
    for _ in range(ROTATIONS):
        before = place[live] - n[live] - 1
        ok = before >= begins[place[live]]
        live, before = live[ok], before[ok]
        live = live[words[before] == words[before + period[live]]]
        n[live] += 1
    for x in live.tolist():  # long ones go by stretches of growing length
        i, q, begin, width = int(place[x] - n[x]), int(period[x]), int(begins[place[x]]), 64
        while i > begin:
            low = max(begin, i - width)
            unlike = np.flatnonzero(words[low:i] != words[low + q : i + q])
            if len(unlike):
                i = low + int(unlike[-1]) + 1
                break
            i, width = low, 2 * width
        n[x] = place[x] - i
    return n


def maximal_runs(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of two periods or more, in places of the tree's array."""
    place, period = tree.branching_repeats()
    end = place + 2 * period
    by = np.lexsort((period, end))
    place, period, end = place[by], period[by], end[by]
    once = np.ones(len(place), bool)  # both halves may have reported it
    once[1:] = (end[1:] != end[:-1]) | (period[1:] != period[:-1])
    place, period, end = place[once], period[once], end[once]
    runs = []
    while len(place):
        new = np.diff(end, prepend=-1) > 0
        i, q, e = place[new], period[new], end[new]
        start = i - _rotations(tree.words, tree.begins, i, q)
        runs.append((start, e - start, q))
        rest = ~new & (place < start[np.cumsum(new) - 1])  # others lie in the run just found
        place, period, end = place[rest], period[rest], end[rest]
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = (np.concatenate(x) for x in zip(*runs))
    return start, length, q


def runs_of(texts: Sequence[Sequence[bytes]], least: int, copies: int) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text that has some, by start, then period."""
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    flat = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64)
    tree = SuffixTree(flat, [len(t) for t in texts])
    start, length, period = maximal_runs(tree)
    keep = length >= np.maximum(least, copies * period)
    start, length, period = start[keep], length[keep], period[keep]
    by = np.lexsort((period, start))
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for s, n, q in zip(start[by].tolist(), length[by].tolist(), period[by].tolist()):
        out[int(tree.text[s])].append((s - int(tree.begins[s]), n, q))
    return out


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: of each run the first period stays, unless another run drops it."""
    if not runs:
        return list(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, copies: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) for each row: the runs by start and period, and the text without repeated words."""

    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least, copies)
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(k, ())] for k in range(len(texts))]
        kept = [b" ".join(collapse(t, found.get(k, ()))).decode() for k, t in enumerate(texts)]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append((text.as_py() or "").encode().split())  # bytes split at ASCII blanks only
                held += len(texts[-1])
                if held >= BLOCK_WORDS:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield block(ids, texts)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with every tenth text (by the CRC-32 of its id) made periodic from some word on, by a rule of the id."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(f"`{text_col}`"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    named = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words"))
    named = named.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
    named = named.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    made = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", source(i).cast("int")))
    text = F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise(F.col(f"`{text_col}`"))
    return named.withColumn(text_col, text).drop("_words", "_n", "_a", "_p")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of :func:`find_runs`: the best run by exact length / period, and digests of runs and text."""

    def better(x, y):  # x stays unless y is better; runs come by start, then period
        return F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    told = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    b = F.col("_best")
    milli = F.floor(F.lit(1000) * b["length"] / b["period"]).cast("long")
    return out.select(id_col, "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


