import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinelake.llm import common, near_dedup
from kinelake.llm import exact_dedup as exact
from kinelake.llm.components import components
from kinelake.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_dedup
from kinelake.llm.near_dedup import drop_near_copies, near_groups

from .conftest import SCHEMA, prose


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(x):
    return -1 if x is None else x


def brute_exact(rows, keep=max):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[lower(text)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stay = keep(known) if known else None
        first = True
        for i in sorted(ids, key=key):
            kept = i == stay and first
            first = first and not kept
            out.append((key(i), key(stay), len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(tricky, tricky_rows, keep):
    got = sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(tricky, keep=keep).collect())
    assert got == brute_exact(tricky_rows, max if keep == "max" else min)


def test_colliding_digests_are_told_apart_by_bytes(tricky, tricky_rows, monkeypatch):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    monkeypatch.setattr(exact, "sha256_of", weak)
    rows = drop_exact_copies(tricky).collect()
    assert sorted(lower(r.text) for r in rows) == sorted({lower(t) for _, t, *_ in tricky_rows})
    monkeypatch.undo()
    got = sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(tricky, digest=weak).collect())
    assert got == brute_exact(tricky_rows)


def test_dropping_keeps_one_row_of_each_text(tricky, tricky_rows):
    out = drop_exact_copies(tricky)
    assert out.columns == tricky.columns and out.schema == tricky.schema
    rows = out.collect()
    assert sorted(lower(r.text) for r in rows) == sorted({lower(t) for _, t, *_ in tricky_rows})
    stay = {t: i for i, t, *_ in ()}
    for doc, text, *_ in tricky_rows:
        stay[lower(text)] = max(stay.get(lower(text), -1), key(doc))
    assert all(key(r.doc_id) == stay[lower(r.text)] for r in rows)


def test_empty_tables(empty):
    assert exact_dedup(empty).collect() == []
    assert drop_exact_copies(empty).collect() == []
    assert near_groups(empty).collect() == []
    assert drop_near_copies(empty).collect() == []


def test_index_probes_and_later_runs(spark):
    index = DigestIndex(spark)
    for batch in ([("a", 1), ("b", 2)], [("a", 7), ("c", 3)], [("a", None), ("d", None), ("d", None)]):
        index.flush(spark.createDataFrame(batch, "digest string, id long"))
    assert {(r.digest, r.keep_id, r.n) for r in index.hits().collect()} == {("a", 7, 3), ("d", None, 2)}
    assert {r.digest for r in index.marked().where("_hit").collect()} == {"a", "d"}  # the filters settle the others
    assert sorted(r.id for r in index.probe(["a", "c"]).where("id is not null").collect()) == [1, 3, 7]
    plan = index.probe(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(digest" in plan or "PushedFilters: [IsNotNull(digest), EqualTo(digest" in plan


def test_levels_merge_a_hot_digest(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), F.col("id") % 2000)).alias("digest"), "id").repartition(40)
    index = DigestIndex(spark, "min")
    index.flush(rows)
    want = {}
    for r in rows.collect():
        low, n = want.get(r.digest, (r.id, 0))
        want[r.digest] = min(low, r.id), n + 1
    assert {r.digest: (r.keep_id, r.n) for r in index.hits().collect()} == {k: v for k, v in want.items() if v[1] > 1}


def shingled(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_near(rows):
    sets = {}
    for doc, text, *_ in rows:
        if doc is not None:
            sets.setdefault(doc, []).append(shingled(text))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_groups_of_tricky_rows(tricky, tricky_rows):
    want = brute_near(tricky_rows)
    rows = near_groups(tricky).collect()
    assert len(rows) == len(tricky_rows)
    sizes = defaultdict(set)
    for doc, text, *_ in tricky_rows:
        sizes[doc].add(len(shingled(text)))
    for r in rows:
        assert r.n_shingles in sizes[r.doc_id]
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def family(rng, n):
    """A chain and a star of edited copies, and texts that only share a passage."""
    base = prose(rng, 200).split()
    rows, words = [], list(base)
    for _ in range(n):
        words = list(words)
        words[rng.randrange(len(words))] = f"w{rng.random()}"
        rows.append(" ".join(words))
    for _ in range(n):
        star = list(base)
        for _ in range(rng.randrange(1, 6)):
            star[rng.randrange(len(star))] = f"v{rng.random()}"
        rows.append(" ".join(star))
    passage = prose(rng, 120)
    rows += [passage + " " + prose(rng, rng.randrange(50, 120)) for _ in range(n)]
    return rows


def test_near_groups_of_chains_stars_and_passages(spark):
    rng = random.Random(11)
    texts = family(rng, 25)
    rng.shuffle(texts)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([r + (None,) * 9 for r in rows], SCHEMA)
    want = brute_near(rows)
    got = {r.doc_id: r.component_id for r in near_groups(docs).collect()}
    assert got == want
    kept = sorted(r.doc_id for r in drop_near_copies(docs).collect())
    assert kept == sorted(set(want.values()))


def test_components_of_nothing(spark):
    none = spark.createDataFrame([(3, 3)], "a long, b long")
    assert components(none, common.Scratch(spark, "test")).collect() == []
    assert components(none, common.Scratch(spark, "test"), one_task=0).collect() == []


def test_blocks_of_a_token_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SQUARE", 7)
    rows = [(5, i, 40, 0) for i in range(60)] + [(9, i, 40, 1) for i in range(0, 60, 3)]
    prefixes = spark.createDataFrame(rows, "token long, id long, n long, place long")
    labels = spark.createDataFrame([(i, 0 if i < 20 else 20) for i in range(40)], "node long, comp long")
    got = {(r.a, r.b) for r in near_dedup._across(prefixes, labels, 75, common.Scratch(spark, "test")).collect()}
    comp = lambda i: 0 if i < 20 else 20 if i < 40 else i
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if comp(a) != comp(b)}


def test_dropping_near_copies_keeps_columns(tricky, tricky_rows):
    out = drop_near_copies(tricky)
    assert out.columns == tricky.columns
    want = brute_near(tricky_rows)
    assert {r.doc_id for r in out.collect()} == {d for d, c in want.items() if d == c} | {None}


@pytest.mark.parametrize("one_task", [0, 60, 1 << 21])
def test_components_against_union_find(spark, one_task):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)] + [(5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "test"), one_task=one_task).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_hot_groups_join_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = common.join_groups(rows, groups, "k", "n", how="inner")
    assert out.count() == 5000 and out.where("k = 0 and top = 1999 and n = 2000").count() == 2000


def test_bitmap_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    marked = common.might_contain(spark.range(3000).select(F.col("id").cast("string").alias("k")), "k", common.bitmap_filter(keys, "k", 1 << 16))
    assert marked.join(keys, "k").where("not _hit").count() == 0
    assert marked.where("_hit").count() < 1200
