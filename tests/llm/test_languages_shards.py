import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import langid, sharding

from ..conftest import MEDIUM, SMALL


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.languages(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in true if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_tricky_rows(spark, tricky, tricky_rows, empty):
    rows = langid.languages(tricky).collect()
    assert len(rows) == len(tricky_rows)
    by_text = {(r.doc_id): r for r in rows if r.doc_id is not None}
    for doc, text, *_ in tricky_rows:
        if doc is not None:
            assert by_text[doc].lang_pred == ("en" if text and any(c.isalpha() for c in text) else "und")
    assert langid.languages(empty).collect() == []
    nothing = langid.languages(tricky.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_mixtures_and_penalty():
    p = np.full((langid.BUCKETS, 3), 1e-9)
    for k in range(3):
        p[k * 100 : (k + 1) * 100, k] = 1
    p /= p.sum(axis=0)
    model = langid.LanguageModel(["a", "b", "c"], p)
    counts = np.zeros(langid.BUCKETS, np.int64)
    counts[:100], counts[100:200] = 6, 2
    share = model.mixture(counts)
    assert share[0] == pytest.approx(0.75, abs=0.01) and share[1] == pytest.approx(0.25, abs=0.01) and share[2] == 0


def test_of_equal_languages_the_first_wins():
    p = np.full((langid.BUCKETS, 1), 1 / langid.BUCKETS)
    contest = langid.Contest(np.ones(langid.BUCKETS, np.int64))
    for names in (["m", "z"], ["c"], ["d", "x"]):
        contest.meet(langid.LanguageModel(names, np.hstack([p] * len(names))))
        assert contest.languages == [min(names[0], contest.languages[0])]
    assert contest.winner() == ("c", 1.0)


def test_blocks_agree_with_one_model(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = {r.doc_id: r.lang_pred for r in langid.languages(docs).collect()}
    monkeypatch.setattr(langid, "BLOCK", 2)
    monkeypatch.setattr(langid, "HELD", 2)
    parts = {r.doc_id: r.lang_pred for r in langid.languages(docs).collect()}
    assert parts == whole


def test_five_thousand_languages(spark):
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    alphabets = [rng.choice(letters, 12) for _ in range(5000)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k], 5)) for _ in range(60))
    learned = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 4 != 2][:5000]
    held = [i for i in range(8000, 9000) if zlib.crc32(str(i).encode()) % 4 == 2][:8]
    rows = [(i, text(k), f"l{k}") for k, i in enumerate(learned)] + [(i, text(600 * k), None) for k, i in enumerate(held)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in langid.languages(docs).where(F.col("doc_id") >= 8000).collect()}
    assert [got[i].lang_pred for i in held] == [f"l{600 * k}" for k in range(8)]
    assert all(r.held_out and 0.5 < r.score <= 1 for r in got.values())


def test_long_texts_count_like_their_parts(monkeypatch):
    text = "Ein kurzer Satz, der sich wiederholt; " * 500
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "SPAN", 1000)
    parts = langid.gram_counts(text)
    assert np.abs(whole - parts).sum() <= 0.02 * whole.sum()


def brute_depths(rows, limit):
    import hashlib

    h = [(doc, n, int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:15], 16)) for doc, n in rows]
    out = []
    for doc, n, bits in h:
        for d in range(61):
            if sum(m for _, m, b in h if b >> (60 - d) == bits >> (60 - d)) <= limit:
                out.append((doc, n, d, bits >> (60 - d)))
                break
    return out


@pytest.mark.parametrize("limit", [2_000, 20_000, 10_000_000])
def test_shards_split_only_where_they_must(spark, limit):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sharding.assign(docs, limit)
    want = brute_depths([(r.doc_id, r.n) for r in docs.select("doc_id", F.octet_length("text").alias("n")).collect()], limit)
    got = [(r.doc_id, r.n_bytes, r.depth, r.prefix) for r in rows.collect() if r.depth < 60 or r.n_bytes <= limit]
    assert sorted(got) == sorted(x for x in want)
    for r in sharding.directory(rows).collect():
        assert r.n_bytes <= limit or r.documents == 1


def test_shards_of_tricky_rows(spark, tricky, tricky_rows, empty):
    rows = sharding.assign(tricky, 3000).collect()
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for _, t, *_ in tricky_rows)
    sizes, count = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(n <= 3000 or count[s] == 1 for s, n in sizes.items())
    assert sharding.assign(empty).collect() == []


def test_one_repeated_id_fills_pages(spark):
    docs = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    pages = {r.shard: r.n_bytes for r in sharding.directory(sharding.assign(docs, 1050)).collect()}
    assert len(pages) == 100 and set(pages.values()) == {1000}


def brute_mixture(model, counts, steps=200):
    """Best of all sets of at most two languages on a fine grid, by penalised likelihood."""
    at = np.flatnonzero(counts)
    n, p = counts[at], model.probability[at]
    penalty = langid.PENALTY * np.log(n.sum() + 1)
    best = None
    for i in range(p.shape[1]):
        for j in range(i, p.shape[1]):
            for u in np.linspace(0, 1, steps + 1) if i != j else [1.0]:
                share = np.zeros(p.shape[1])
                share[i] += u
                share[j] += 1 - u
                value = float(n @ np.log(p @ share)) - penalty * (1 if i == j or u in (0.0, 1.0) else 2)
                if best is None or value > best[0]:
                    best = value, share
    return best[1]


def test_mixtures_against_brute_force():
    rng = np.random.default_rng(8)
    table = rng.gamma(0.3, size=(langid.BUCKETS, 3)) + 1e-4
    model = langid.LanguageModel(["a", "b", "c"], table / table.sum(axis=0))
    for share in ([1, 0, 0], [0, 0.7, 0.3], [0.5, 0, 0.5], [0, 0, 1], [0.2, 0.8, 0]):
        counts = rng.multinomial(600, model.probability @ np.array(share, float))
        got, want = model.mixture(counts), brute_mixture(model, counts)
        assert np.abs(got - want).max() < 0.02
        assert np.argmax(got) == np.argmax(want)


def test_warm_starts_find_the_same_maximum():
    rng = np.random.default_rng(9)
    p, n = rng.gamma(0.5, size=(400, 4)) + 1e-3, rng.integers(1, 9, 400).astype(float)
    p /= p.sum(axis=0)
    cold = langid._em(p, n, n.sum())
    warm = langid._em(p, n, n.sum(), np.array([0.91, 0.03, 0.03, 0.03]))
    assert warm[1] == pytest.approx(cold[1], abs=0.05)


def test_many_rows_of_one_id_fill_pages(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    shards = sharding.directory(sharding.assign(rows, limit=5000)).collect()
    assert sum(r.documents for r in shards) == 20_000 and len(shards) == 400 and all(r.n_bytes == 5000 for r in shards)


def test_rows_of_one_id_and_many_sizes_share_pages(spark):
    rows = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.expr("repeat('x', cast(8000 + id as int))").alias("text"))
    shards = sharding.directory(sharding.assign(rows)).collect()
    assert sum(r.documents for r in shards) == 300 and len(shards) == 3 and all(r.n_bytes <= sharding.LIMIT for r in shards)


def test_pages_of_any_sizes_fit(spark):
    """Sizes from none to above the limit, most of them repeated, of two ids; every row once, no page above the limit."""
    size = F.when(F.col("id") % 3 == 0, F.lit(100)).otherwise(F.pmod(F.xxhash64("id"), F.lit(2500))).cast("int")
    rows = spark.range(4000).select((F.col("id") % 2).alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"))
    assigned = sharding.assign(rows, limit=2000)
    shards = sharding.directory(assigned).collect()
    want = sorted((r.doc_id, r.n) for r in rows.select("doc_id", F.length("text").alias("n")).collect())
    assert sorted((r.doc_id, r.n_bytes) for r in assigned.collect()) == want
    assert all(r.n_bytes <= 2000 or r.documents == 1 for r in shards)
    small = [n for _, n in want if n <= 1000]
    shared = [r for r in shards if r.n_bytes <= 2000 and r.documents > 1]
    assert sum(r.n_bytes for r in shared) > 0.6 * 2000 * (len(shared) - 2 * sharding.CLASSES) and sum(r.documents for r in shared) > 0.9 * len(small)
