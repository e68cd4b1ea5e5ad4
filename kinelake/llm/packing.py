"""Best-fit packing of token sequences by bin completion with branch and bound.

Only lengths matter to the plan, and there are at most ``capacity`` of them. So executors cut the texts and count pieces
by length, the driver plans over that histogram (its size does not grow with the corpus), and executors place each piece
by its rank within its length.

Greedy dives give the incumbent: each fills a sequence around the largest remaining piece, enumerates fillings of the
rest largest piece first, and uses the one chosen as often as its pieces allow. If the incumbent is above the lower bound
(all tokens / capacity, and dual feasible functions of the lengths), and there are at most ``RELAXED`` lengths, the
linear relaxation over fillings is solved by column generation: its prices are one more dual feasible function, and its
fillings, each used a whole number of times, with a plan of the few pieces left, one more incumbent. Where a gap stays, a
depth-first search follows. It branches over the fillings of the largest piece and over how often each is used, leaves
out fillings that an exchange of pieces dominates, takes the fillings of one largest piece in descending order only, and
cuts a partial plan whose sequences and lower bound for the rest reach the incumbent. It ends with an optimal plan, or
after ``EFFORT`` steps with the best plan found; the log says which, with the gap to the bound.

Defined results: a null text counts as empty, and a document is its ids and one end id, so every row has a piece; only
documents above the capacity are cut, at multiples of it; repeated rows each get their own pieces; an empty table gives
an empty result; columns other than id and text are ignored and may have any name.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load, out_batches, pairs
from .common import Scratch

#: Fillings that one sequence of a dive may try, and dives: they choose among two fillings by parity, so there are three.
FILLINGS, DIVES = 400, 3
#: Steps of the search, and fillings that it sorts by waste at a time.
EFFORT, SORTED = 1_000_000, 64
#: Most lengths whose relaxation is solved (its matrix has a row and a column for each), and most columns that it takes in
#: (prices that are not final give a bound too); prices are rounded to this unit.
RELAXED, COLUMNS, UNIT = 200, 2_000, 10**9
#: Pieces of one length in one ranking task, about.
RANKED = 50_000

Pattern = tuple[tuple[int, int], ...]


class Lengths:
    """Remaining pieces by length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.count)

    def take(self, pattern: Pattern, times: int) -> None:
        for length, k in pattern:
            self.count[length] -= k * times
            if not self.count[length]:
                del self.count[length]
                self.sorted.pop(bisect_right(self.sorted, length) - 1)

    def give(self, pattern: Pattern, times: int) -> None:
        for length, k in pattern:
            if length not in self.count:
                self.count[length] = 0
                insort(self.sorted, length)
            self.count[length] += k * times

    def times(self, pattern: Pattern) -> int:
        return min(self.count[length] // k for length, k in pattern)


def fillings(have: Lengths, room: int, used: dict[int, int], limit: int) -> Iterator[list[int]]:
    """Undominated fillings of ``room``, each leaving less waste than those before; the first is the best fit."""
    best, tried = -1, 0
    stack: list[tuple[list[int], int, int]] = [([], room, room)]  # pieces so far, room left, largest next piece
    order = have.sorted
    while stack and tried < limit:
        chosen, left, most = stack.pop()
        k = bisect_right(order, min(left, most)) - 1
        while k >= 0 and used.get(order[k], 0) + chosen.count(order[k]) >= have.count[order[k]]:
            k -= 1
        if k < 0:  # nothing more fits
            tried += 1
            if room - left > best:
                best = room - left
                yield chosen
                if not left:
                    return
            continue
        length = order[k]
        if length == left:  # an exact piece dominates every other way to fill what is left
            yield [*chosen, length]
            return
        if k > 0:
            stack.append((chosen, left, length - 1))  # later: without this length
        stack.append(([*chosen, length], left - length, length))


def dive(counts: dict[int, int], capacity: int, choose) -> list[tuple[Pattern, int]]:
    """One plan: (pieces of a sequence by length, number of such sequences). ``choose`` picks among the fillings."""
    have, plan = Lengths(counts), []
    while have.sorted:
        largest = have.sorted[-1]
        found = list(fillings(have, capacity - largest, {largest: 1}, FILLINGS))
        pieces = [largest, *choose(found)]
        pattern = tuple(sorted(((x, pieces.count(x)) for x in set(pieces)), reverse=True))
        times = have.times(pattern)
        have.take(pattern, times)
        plan.append((pattern, times))
    return plan


def bounds(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Dual feasible functions as (weight by length, unit): no sequence weighs more than one unit. The first is the length.

    The others are the best of three families (Fekete and Schepers) on these counts, over all their parameters.
    """
    x = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    small = x[2 * x <= capacity].tolist()
    out = [(x, capacity)]
    rounded = ((np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity), k * capacity) for k in range(1, 101))
    cut = ((np.where(x > capacity - e, capacity, np.where(x < e, 0, x)), capacity) for e in small)
    counted = ((np.where(2 * x > capacity, capacity // e - (capacity - x) // e, x >= e).astype(np.int64), capacity // e) for e in small)
    for family in (rounded, cut, counted):
        best = max(family, key=lambda wu: int((wu[0] * n).sum()) / wu[1], default=None)
        if best is not None:
            out.append(best)
    return [(dict(zip(x.tolist(), w.tolist())), unit) for w, unit in out]


def lower_bound(counts: dict[int, int], functions: list[tuple[dict[int, int], int]]) -> int:
    return max(-(-sum(w[x] * n for x, n in counts.items()) // unit) for w, unit in functions)


def heaviest(worth: np.ndarray, lengths: list[int], most: list[int], capacity: int) -> tuple[float | int, np.ndarray]:
    """The filling of most worth with at most so many pieces of each length: a knapsack over doubled pieces."""
    best = np.zeros(capacity + 1, worth.dtype)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i, (length, n) in enumerate(zip(lengths, most)):
        k = 1
        while n > 0 and worth[i] > 0:
            k = min(k, n)
            with_it = best[: capacity + 1 - k * length] + k * worth[i]
            better = with_it > best[k * length :]
            best[k * length :] = np.where(better, with_it, best[k * length :])
            steps.append((i, k, better))
            n, k = n - k, 2 * k
    pieces, room = np.zeros(len(lengths), np.int64), capacity
    for i, k, better in reversed(steps):
        if room >= k * lengths[i] and better[room - k * lengths[i]]:
            pieces[i] += k
            room -= k * lengths[i]
    return best[capacity].item(), pieces


def relaxation(counts: dict[int, int], capacity: int, columns: int = COLUMNS) -> tuple[list[tuple[Pattern, int]], tuple[dict[int, int], int]]:
    """(fillings with whole numbers of uses that leave pieces over, the prices as a dual feasible function).

    Column generation (Gilmore and Gomory): the simplex method over fillings, whose next column is a knapsack by the
    prices of the present basis. The prices, divided by the worth of that column, are feasible at any time.
    """
    lengths = sorted(counts, reverse=True)
    wanted = np.array([counts[x] for x in lengths], np.float64)
    most = [min(counts[x], capacity // x) for x in lengths]
    basis = np.diag(np.array(most, np.float64))
    uses = wanted / np.array(most)
    best, prices = -1.0, np.zeros(len(lengths))
    for _ in range(columns):
        price = np.maximum(np.linalg.solve(basis.T, np.ones(len(lengths))), 0)
        worth, pieces = heaviest(price, lengths, most, capacity)
        if price @ wanted / worth > best:
            best, prices = price @ wanted / worth, price / worth
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, pieces.astype(np.float64))
        able = np.flatnonzero(change > 1e-9)
        leaving = able[np.argmin(uses[able] / change[able])]
        step = uses[leaving] / change[leaving]
        uses = np.maximum(uses - step * change, 0)
        uses[leaving], basis[:, leaving] = step, pieces
    # Rounded prices and the exact worth of their heaviest filling are a dual feasible function without rounding errors.
    rounded = np.floor(prices * UNIT).astype(np.int64)
    unit, _ = heaviest(rounded, lengths, most, capacity)
    plan, left = [], dict(counts)
    for k in np.argsort(-uses, kind="stable").tolist():
        pattern = tuple((x, int(n)) for x, n in zip(lengths, basis[:, k].round().astype(int)) if n)
        times = min(int(uses[k] + 1e-6), *(left[x] // n for x, n in pattern))
        if times > 0:
            plan.append((pattern, times))
            for x, n in pattern:
                left[x] -= n * times
    return plan, (dict(zip(lengths, rounded.tolist())), max(1, unit))


class Search:
    """Depth-first branch and bound from an incumbent. ``proven`` says whether it ended with an optimal plan."""

    def __init__(self, counts: dict[int, int], capacity: int, plan: list[tuple[Pattern, int]], functions: list[tuple[dict[int, int], int]], effort: int):
        self.have, self.capacity, self.functions, self.effort = Lengths(counts), capacity, functions, effort
        self.best, self.size = plan, sum(n for _, n in plan)
        self.bound = lower_bound(counts, functions)
        self.left = [sum(w[x] * n for x, n in counts.items()) for w, _ in functions]
        self.used = 0

    def slack(self) -> int:
        """Tokens that the rest of a better plan may waste."""
        return (self.size - 1 - self.used) * self.capacity - self.left[0]

    def undominated(self, largest: int, ceiling: Pattern | None) -> Iterator[Pattern]:
        """Fillings around ``largest`` below ``ceiling``, in descending order, that no exchange with a piece outside improves.

        An exchange puts a larger piece in place of a smaller one, or of all that follows a prefix, or into room that is
        left. It makes the sequence greater in this order and keeps the plan whole, so the greatest optimal plan has none.
        """
        count, order = self.have.count, self.have.sorted
        stack: list[tuple[Pattern, int, int]] = []
        for k in range(1, min(count[largest], self.capacity // largest) + 1):
            stack.append((((largest, k),), self.capacity - k * largest, largest))
        while stack and self.effort > 0:
            self.effort -= 1
            prefix, room, below = stack.pop()
            if ceiling is not None and prefix > ceiling[: len(prefix)]:
                continue
            taken = dict(prefix)
            spare = lambda x: count.get(x, 0) - taken.get(x, 0)
            if room and spare(room) > 0:  # an exact piece dominates all else
                if room >= below:
                    continue
                prefix, room = (*prefix, (room, 1)), 0
            at = bisect_left(order, min(room + 1, below)) - 1
            if room and at >= 0:
                length = order[at]
                stack.append((prefix, room, length))
                stack.extend(((*prefix, (length, k)), room - k * length, length) for k in range(1, min(count[length], room // length) + 1))
                continue
            if room > self.slack() or (ceiling is not None and prefix >= ceiling):
                continue
            # Pieces that were passed over are lengths of the prefix or larger ones than what followed.
            if room and any(spare(y) > 0 for x in (0, *taken) for y in order[bisect_right(order, x) : bisect_right(order, x + room)]):
                continue
            yield prefix

    def branches(self, ceiling: Pattern | None) -> Iterator[tuple[Pattern, int]]:
        """(filling, times), the least waste of each batch first; most times first, then halves, then all between."""
        found = self.undominated(self.have.sorted[-1], ceiling)
        while batch := list(islice(found, SORTED)):
            batch.sort(key=lambda p: self.capacity - sum(x * k for x, k in p))  # stable: descending within a waste
            for pattern in batch:
                most = self.have.times(pattern)
                halves = [most >> k for k in range(most.bit_length())]
                yield from ((pattern, t) for t in halves)
                among = set(halves)
                yield from ((pattern, t) for t in range(most - 1, 0, -1) if t not in among)

    def move(self, pattern: Pattern, times: int) -> None:
        """Uses a filling; times below zero take it back."""
        if times > 0:
            self.have.take(pattern, times)
        else:
            self.have.give(pattern, -times)
        self.used += times
        for i, (w, _) in enumerate(self.functions):
            self.left[i] -= times * sum(w[x] * k for x, k in pattern)

    def run(self) -> list[tuple[Pattern, int]]:
        path: list[tuple[Pattern, int]] = []
        levels = [self.branches(None)] if self.size > self.bound else []
        while levels and self.size > self.bound and self.effort > 0:
            self.effort -= 1
            branch = next(levels[-1], None)
            if branch is None:
                levels.pop()
                if path:
                    pattern, times = path.pop()
                    self.move(pattern, -times)
                continue
            self.move(*branch)
            if not self.have.sorted and self.used < self.size:
                self.best, self.size = [*path, branch], self.used
            if self.used + max(-(-left // unit) for left, (_, unit) in zip(self.left, self.functions)) >= self.size:
                self.move(branch[0], -branch[1])
                continue
            path.append(branch)
            same = self.have.sorted[-1] == branch[0][0][0]
            levels.append(self.branches(branch[0] if same else None))
        self.proven = self.size <= self.bound or self.effort > 0
        return self.best


def size_of(plan: list[tuple[Pattern, int]]) -> int:
    return sum(n for _, n in plan)


def plan_sequences(counts: dict[int, int], capacity: int, dives: int = DIVES, effort: int = EFFORT) -> list[tuple[Pattern, int]]:
    """An optimal plan if the bounds or the search prove one within its effort, else the best plan found."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    plan, bound = _planned({k: n for k, n in counts.items() if n > 0}, capacity, dives, effort)
    size = size_of(plan)
    logging.getLogger(__name__).info("%d sequences, %s", size, "proven optimal" if size <= bound else f"at most {size - bound} too many")
    return plan


def _planned(counts: dict[int, int], capacity: int, dives: int, effort: int) -> tuple[list[tuple[Pattern, int]], int]:
    """(plan, a number of sequences that no plan can go below)."""
    bound = -(-sum(k * n for k, n in counts.items()) // capacity)
    best: list[tuple[Pattern, int]] | None = None
    for d in range(dives):
        pick = lambda found, d=d: found[-1 - (d > 0) * ((d + len(found)) % min(len(found), 2))] if found else []
        plan = dive(counts, capacity, pick)
        if best is None or size_of(plan) < size_of(best):
            best = plan
        if size_of(best) <= bound:
            return best, bound
    best = best or []
    functions = bounds(counts, capacity)
    if size_of(best) > lower_bound(counts, functions) and len(counts) <= RELAXED:
        whole, prices = relaxation(counts, capacity)
        functions.append(prices)
        if whole and size_of(best) > lower_bound(counts, functions):
            left = Lengths(counts)
            for pattern, times in whole:
                left.take(pattern, times)
            rest, _ = _planned(left.count, capacity, dives, effort)
            best = min(best, whole + rest, key=size_of)
    search = Search(counts, capacity, best, functions, effort)
    plan = search.run()
    return plan, search.size if search.proven else search.bound


def _places(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """(length, first rank, first sequence, pieces of that length in a sequence, offset), sorted."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, k in pattern:
            rows.append((length, given.get(length, 0), sequence, k, offset))
            given[length] = given.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of each document's ids and end id."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = np.array([end], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, ids in load(path).encode_all(pairs(batches)):
            ids += last
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc, piece, at // 4, len(part) // 4, zlib.crc32(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(pieces(batches), schema, lambda _: 40)

    return narrow.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to (id, piece, start, length, ...). ``pieces`` should be a written table: it is read twice."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    places = _places(plan_sequences(counts, capacity))
    # A length may hold a third of all pieces: it is ranked in buckets, whose sizes give each bucket its first rank.
    buckets = max(16, sum(counts.values()) // RANKED)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("id", "piece", "start"))
    ranked = dealt.withColumn("_own", own).join(first.drop("_n"), ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_own") - 1 + F.coalesce("_first", F.lit(0))).drop("_own", "_first", "_bucket")
    names = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.select(*names).dtypes) + ", sequence_id long, `offset` long"
    starts = places[:, 0] << 40 | places[:, 1] if len(places) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c)), np.int64) for c in ("length", "_rank"))
            at = places[np.searchsorted(starts, length << 40 | rank, "right") - 1]
            step = rank - at[:, 1]
            added = [pa.array(at[:, 2] + step // at[:, 3]), pa.array(at[:, 4] + step % at[:, 3] * length)]
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(kept + added, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put("pieces", cut(docs, path, capacity, end, id_col, text_col))
    out = pack(pieces, capacity)
    order = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*order).withColumnRenamed("id", id_col)
