"""Near-duplicate groups by tensored MinHash banding with exact verification.

Two collections of ``side`` small signatures are computed for a text, each of ``half`` minhashes. The key of table
(i, j) is signature i of the first joined with signature j of the second, so side * side tables of 2 * half minhashes
each cost only 2 * side * half minhashes. At similarity s a pair shares some table with probability
(1 - (1 - s ** half) ** side) ** 2: 0.9995 at 0.75 and 0.99993 at 0.8 with the defaults.

Texts with the same shingle set are one node from the start (its smallest id). In each table's bucket the smallest node
is the centre, and a node is compared with the centre that it shares most tables with; a pair counts only if the full
shingle sets confirm it. Nodes that stay outside their buckets' largest components try a few other centres there. Some
buckets still hold several components then. Their nodes are compared across components wherever two share a shingle
among the first quarter of their sets in one common order, rare shingles first, at places that leave room for the
similarity asked for: an exact condition, which texts that share no more than a frequent passage fail. So no candidate
link between different components is lost. A group of g near copies costs about g comparisons; only where many texts
lie just below the threshold from each other does the condition leave more.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased.
Defined results: a text with one to four words has one shingle; a null or blank text has none, links with nothing and is
kept; rows with one id are one document, with all their texts; rows with a null id are never linked (component null,
kept); an empty table gives an empty result; columns other than id and text are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .bpe import out_batches
from .common import BITMAP_BITS, Scratch, bitmap_filter, bits_for, join_groups, might_contain
from .components import components

WORDS, PERCENT, SIDE, HALF = 5, 75, 10, 2
WORDS_KEPT = 150_000
#: Pairs of one centre that one comparing task run takes.
SALTED = 128
#: Turns of other centres, and centres that a node tries in each.
TURNS, TRIES = 2, 4
#: Sets with one token that one block of a self-join takes.
SQUARE = 1024
#: Sets that must have a shingle for it to come late in the common order.
FREQUENT = 8
_ODD = np.random.default_rng(2024).integers(1, 1 << 62, size=(64, 2), dtype=np.uint64) | np.uint64(1)
#: Multipliers of the minhashes, as many as any side and half may ask for.
_TIMES = np.random.default_rng(99).integers(1, 1 << 62, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _MIX[2])) * _MIX[0]
    x = (x ^ (x >> _MIX[2])) * _MIX[1]
    return x ^ (x >> _MIX[2])


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word windows."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out + h[k : n - width + 1 + k] * _ODD[k, 0]
    return np.unique(_mixed(out))


def signatures(found: np.ndarray, side: int = SIDE, half: int = HALF) -> np.ndarray:
    """2 * side signatures, each of ``half`` minhashes."""
    least = np.array([(found * t).min() for t in _TIMES[: 2 * side * half]]).reshape(2 * side, half)
    out = np.arange(1, 2 * side + 1, dtype=np.uint64)
    for k in range(half):
        out = _mixed(out * _MIX[0] + least[:, k])
    return out


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, side: int = SIDE, half: int = HALF) -> DataFrame:
    """(id, n, digest, sig): set size, 128-bit digest of the set, and the signatures (none for an empty set)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        with np.errstate(over="ignore"):
            for b in batches:
                for i, t in zip(b.column(0), b.column(1)):
                    found = shingles(t.as_py(), size)
                    sig = signatures(found, side, half).view(np.int64).tolist() if len(found) else []
                    yield i.as_py(), len(found), xxh3_128_digest(found.tobytes()), sig

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(rows(batches), schema, lambda _: 200)

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id long, n long, digest binary, sig array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("found", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        with np.errstate(over="ignore"):
            for b in batches:
                for i, t in zip(b.column(0), b.column(1)):
                    found = shingles(t.as_py(), size)
                    yield i.as_py(), len(found), found.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(rows(batches), schema)

    return _narrow(docs, id_col, text_col).mapInArrow(run, "id long, n long, found binary")


def _keys(sketches: DataFrame, side: int) -> DataFrame:
    """(key, id): one row for each table."""
    tensor = f"flatten(transform(slice(sig, 1, {side}), (x, i) -> transform(slice(sig, {side + 1}, {side}), (y, j) -> xxhash64(x, y, i * {side} + j))))"
    return sketches.select(F.expr(f"explode({tensor})").alias("key"), "id")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as a written table. ``pairs`` is a written table too.

    Pairs are gathered by centre: each run of rows has the centre's set first, then those of its partners, and a worker
    holds one centre and one record batch at a time. A centre of many pairs is dealt to several runs. Partners of too
    different a size stay behind; an id with several texts has a range of sizes.
    """
    if not pairs.take(1):
        return pairs.select("a", "b")
    sizes = sets.groupBy(F.col("id").alias("a")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    runs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_pairs")).withColumn("runs", F.expr(f"cast(ceil(_pairs / {SALTED}) as int)"))
    runs = scratch.put(f"{label}-runs", runs.join(sizes, "a"))
    dealt = join_groups(pairs.select("a", "b"), runs, "a", "_pairs", how="inner").select("a", "low", "high", F.expr("pmod(xxhash64(b), runs)").cast("int").alias("run"), "b")
    partners = dealt.join(sets.withColumnRenamed("id", "b"), "b").where(f"100 * high >= {percent} * n and 100 * n >= {percent} * low").select("a", "run", "b", "found")
    centres = runs.join(sets.select(F.col("id").alias("a"), "found"), "a").select("a", F.explode(F.expr("sequence(0, runs - 1)")).alias("run"), F.lit(None).cast("long").alias("b"), "found")
    rows = centres.unionByName(partners).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, own = None, []
        for batch in batches:
            for a, run, b, found in zip(*(batch.column(k) for k in range(4))):
                a, run, b = a.as_py(), run.as_py(), b.as_py()
                if (a, run) != at:
                    at, own = (a, run), []
                if b is None:  # an id with several texts has several sets
                    own.append(np.frombuffer(found.as_py(), np.uint64))
                    continue
                other = np.frombuffer(found.as_py(), np.uint64)
                for mine in own:
                    small, large = (mine, other) if len(mine) < len(other) else (other, mine)
                    where = np.searchsorted(large, small)
                    where[where == len(large)] = 0
                    both = int((large[where] == small).sum()) if len(large) else 0
                    if both and 100 * both >= percent * (len(small) + len(large) - both):
                        yield a, b
                        break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(compare(batches), schema, lambda _: 16)

    return scratch.put(label, rows.mapInArrow(run, "a long, b long"))


def _exploded(sets: DataFrame) -> DataFrame:
    """(shingle): one row for each shingle of each set."""
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in b.column(0):
                all_of = np.frombuffer(found.as_py(), np.int64)
                for at in range(0, len(all_of), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(all_of[at : at + (1 << 16)])], schema=schema)

    return sets.select("found").mapInArrow(run, "shingle long")


def _prefixes(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(token, id, n, place), as a written table: the part of each set, in the common order, that two similar sets must both touch.

    The order puts shingles in a filter of frequent ones last. The filter is bounded like every other one, and any order
    gives the same links.
    """
    bits = bits_for(sets.agg(F.sum("n")).first()[0] or 0)
    often = _exploded(sets).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(f"n > {FREQUENT}").select(F.pmod("shingle", F.lit(bits)).alias("w"))
    slots = often.select(F.expr(f"w div {BITMAP_BITS}").alias("slot"), F.expr(f"w % {BITMAP_BITS}").alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    late = np.zeros(bits // 8, np.uint8)
    for r in slots.collect():  # 8 MB at most
        late[r["slot"] * 4096 : (r["slot"] + 1) * 4096] = np.frombuffer(r["bitmap"], np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(late)
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            for i, found in zip(b.column(0), b.column(1)):
                own = np.frombuffer(found.as_py(), np.int64)
                w = own % bits
                order = np.argsort((seen[w >> 3] >> (w & 7).astype(np.uint8)) & 1, kind="stable")
                length = len(own) - -(-percent * len(own) // 100) + 1
                first = own[order[:length]]
                columns = [first, np.full(length, i.as_py()), np.full(length, len(own)), np.arange(length)]
                for at in range(0, length, 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], schema=schema)

    out = scratch.put("prefixes", sets.select("id", "found").mapInArrow(run, "token long, id long, n long, place long"))
    shared.destroy()
    return out


def _across(prefixes: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that the prefixes leave possible.

    A token of many sets is a square of blocks of them, each met by a task of its own.
    """
    own = prefixes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    own = scratch.put("own-prefixes", own)
    tokens = own.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows")).where("low != high")
    tokens = scratch.put("tokens", tokens.select("token", "rows", F.expr(f"cast(ceil(rows / {SQUARE}) as int)").alias("blocks")))
    kept = join_groups(own, tokens, "token", "rows", how="inner").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    a = kept.select("token", F.col("block").alias("i"), every.alias("j"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("ia"), F.col("comp").alias("ca"))
    b = kept.select("token", every.alias("i"), F.col("block").alias("j"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("ib"), F.col("comp").alias("cb"))
    room = f"a < b and ca != cb and 100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * least(na - ia, nb - ib) >= {percent} * (na + nb)"
    return a.join(b, ["token", "i", "j"]).where(room).select("a", "b").distinct()


def _open(members: DataFrame, labels: DataFrame, scratch: Scratch, label: str) -> DataFrame | None:
    """(key, id, comp) of the buckets that hold several components, as a written table; None without any.

    A node without a link is its own component.
    """
    own = members.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    own = scratch.put(f"{label}-own", own)
    mixed = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members")).where("low != high")
    mixed = scratch.put(f"{label}-mixed", mixed.select("key", "members"))
    if not mixed.take(1):
        return None
    out = scratch.put(f"{label}-open", join_groups(own, mixed, "key", "members", how="inner").select("key", "id", "comp"))
    scratch.drop(f"{label}-own", f"{label}-mixed")
    return out


def _recentred(own: DataFrame, turn: int, scratch: Scratch) -> DataFrame:
    """(a, b): nodes outside their bucket's largest component with some node of it, at most TRIES of them each.

    Which node of the component is the centre differs from bucket to bucket and turn to turn, so a centre that few others
    resemble does not keep a group apart.
    """
    parts = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("pick"))
    top = parts.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", F.col("pick.h").alias("h"), F.col("pick.id").alias("id"), "comp")).alias("top"))
    top = scratch.put(f"top-{turn}", top.select("key", "members", F.col("top.id").alias("centre"), F.col("top.comp").alias("largest")))
    pairs = join_groups(own, top, "key", "members", how="inner").where("comp != largest")
    shared = pairs.groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))  # a node is in side * side buckets at most
    return shared.withColumn("_r", rank).where(F.col("_r") <= TRIES).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, side: int = SIDE, half: int = HALF) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each input row."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sketches = scratch.put("sketches", sketch(docs, id_col, text_col, size, side, half))
    linked = sketches.where("id is not null and n > 0")
    # Equal sets are one node.
    groups = scratch.put("groups", linked.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = scratch.put("nodes", linked.join(groups.select("digest", F.col("node").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["digest"]).select("id", "sig"))
    # The nodes of one id's texts are one document.
    repeated = scratch.put("repeated", sketches.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    several = bool(repeated.take(1))
    if several:
        texts = join_groups(linked.select("id", "digest"), repeated, "id", "rows", how="inner").select("id", "digest").distinct()
        same = join_groups(texts, groups, "digest", "copies", how="inner").where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b"))
        same = scratch.put("same", same.distinct())
    # Buckets with more than one node.
    keys = _keys(nodes, side)
    buckets = scratch.put("buckets", keys.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    near = might_contain(keys, "key", bitmap_filter(buckets, "key")).where("_hit").drop("_hit")
    members = scratch.put("members", join_groups(near, buckets, "key", "members", how="inner").select("key", "id", "centre"))
    starred = members.where("id != centre").groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    stars = scratch.put("stars", starred)
    involved = stars.select(F.col("b").alias("id")).unionByName(buckets.select(F.col("centre").alias("id")))
    mine = might_contain(_narrow(docs, id_col, text_col), "id", bitmap_filter(involved, "id")).where("_hit").select("id", "text")
    sets = scratch.put("sets", _sets(mine, "id", "text", size))
    best = stars.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    tried = scratch.put("tried1", best)
    links = _linked(tried, sets, percent, scratch, "links1")
    if several:
        links = links.unionByName(same)
    labels = components(links, scratch, "cc1")
    own = _open(members, labels, scratch, "turn0")
    scratch.drop("members", "stars", "buckets")
    for turn in range(TURNS):  # other centres for what the first ones left apart
        if own is None:
            break
        fresh = scratch.put(f"tried-{turn}", _recentred(own, turn, scratch).join(tried, ["a", "b"], "left_anti"))
        found = _linked(fresh, sets, percent, scratch, f"links-{turn}")
        tried = tried.unionByName(fresh)
        if found.take(1):
            links = links.unionByName(found)
            labels = components(links, scratch, f"cc-{turn}")
            own = _open(own, labels, scratch, f"turn{turn + 1}")
    if own is not None:  # buckets that still hold several components
        some = scratch.put("open-sets", sets.join(scratch.put("open", own.select("id").distinct()), "id", "left_semi"))
        pairs = _across(_prefixes(some, percent, scratch), labels, percent, scratch)
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = scratch.put("across", pairs.join(known, ["a", "b"], "left_anti"))
        found = _linked(fresh, some, percent, scratch, "links2")
        scratch.drop("prefixes", "own-prefixes", "tokens", "open-sets")
        if found.take(1):
            labels = components(links.unionByName(found), scratch, "cc3")
    roots = groups.join(labels.select("node", "comp"), "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id"), "copies")
    roots = scratch.put("roots", roots)
    out = join_groups(sketches.where("id is not null and n > 0").select("id", "n", "digest"), roots, "digest", "copies", how="inner").select("id", "n", "component_id")
    blank = sketches.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    if several:  # a blank row goes with its id's other texts
        others = join_groups(texts.dropDuplicates(["id"]), groups, "digest", "copies", how="inner").join(labels.select("node", "comp"), "node", "left").select("id", F.coalesce("comp", "node").alias("comp"))
        others = scratch.put("others", others.join(repeated, "id").select("id", "comp", "rows"))
        blank = join_groups(blank, others, "id", "rows", how="left").select("id", "n", F.coalesce("comp", "id").alias("component_id"))
    out = out.unionByName(blank)
    scratch.drop("sets", "nodes")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns. Rows surely not dropped stay where they are."""
    scratch = Scratch(docs.sparkSession, "near-drop")
    groups = near_groups(docs, id_col, text_col, size, percent)
    gone = scratch.put("gone", groups.where("not kept").select(F.col(id_col).alias("_id")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = might_contain(docs.select(row, F.col(f"`{id_col}`").cast("long").alias("_id")), "_id", bitmap_filter(gone, "_id"))
    stay = marked.where("not _hit").select("_row")
    return stay.unionByName(marked.where("_hit").join(gone, "_id", "left_anti").select("_row")).select("_row.*")
