"""Periodic runs against quadratic search, and the query's planted texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kinelake.llm import periodic_runs as pr
from kinelake.llm.entry_queries import op11_periodic_runs

from ..conftest import SMALL


def brute(w, least=6, copies=4):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            smaller = any(all(w[k] == w[k + r] for k in range(start, start + n - r)) for r in range(1, q))
            if n >= max(least, copies * q, 2 * q) and not smaller:
                out.append((start, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,copies", [(6, 4), (2, 2)])
def test_small_alphabets(least, copies):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, letters = rng.randrange(50), "abc"[: rng.randrange(1, 4)]
            w = [rng.choice(letters).encode() for _ in range(n)]
            a, p = rng.randrange(n or 1), rng.randrange(1, 7)
            texts.append(w if rng.random() < 0.5 else [w[i if i < a else a + (i - a) % p] for i in range(n)])
        got = pr.runs_of(texts, least, copies)
        assert [got.get(k, []) for k in range(len(texts))] == [brute(w, least, copies) for w in texts]


def test_words_of_fibonacci_and_squares():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    for text in (b, "aab" * 40 + "a", "abcabcabc" * 9, "ab" * 30 + "c" + "ab" * 30):
        w = [c.encode() for c in text]
        assert pr.runs_of([w], 2, 2).get(0, []) == brute(w, 2, 2)


@pytest.mark.parametrize("jumps", [0, 1, 16])
def test_smaller_before(jumps, monkeypatch):
    monkeypatch.setattr(pr, "JUMPS", jumps)
    rng = np.random.default_rng(jumps)
    for _ in range(300):
        v = rng.integers(0, rng.integers(1, 30) + 1, rng.integers(1, 60))
        v[0] = 0
        got = pr.smaller_before(v)
        for s in np.flatnonzero(v).tolist():
            assert got[s] == max(p for p in range(s) if v[p] < v[s])


@pytest.mark.parametrize("text,runs", [([b"x"] * 300_000, [(0, 300_000, 1)]), ([str(i).encode() for i in range(300_000)], []), ([b"x"] * 100_000 + [b"y"] + [b"x"] * 50_000, [(0, 100_000, 1), (100_001, 50_000, 1)])])
def test_long_texts(text, runs):
    assert pr.runs_of([text], 6, 4).get(0, []) == runs


def test_leaves_in_pieces(monkeypatch):
    monkeypatch.setattr(pr, "LEAVES_AT_ONCE", 3)
    w = [c.encode() for c in "abab" * 9 + "aabb" * 9]
    assert pr.runs_of([w], 2, 2)[0] == brute(w, 2, 2)


def expected(row_id, text, plant=False):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(row_id).encode())
    if plant and row_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs, best, dropped = brute(w), None, set()
    for r in runs:
        best = r if best is None or r[1] * best[2] > best[1] * r[2] else best
        dropped.update(range(r[0] + r[2], r[0] + r[1]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if best else None
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (row_id, len(runs), *(best or (None,) * 3), milli, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_edge_rows(spark, tricky, tricky_rows, monkeypatch):
    texts = [r for r in tricky_rows if len(r[1] or "") < 20_000]
    want = sorted((expected(r[0], r[1]) for r in texts), key=str)
    found = pr.find_runs(tricky.where("text is null or length(text) < 20000"))
    assert sorted((tuple(r) for r in pr.run_digests(found).collect()), key=str) == want
    whole = pr.find_runs(tricky).collect()
    assert len(whole) == len(tricky_rows) and all(r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for r, t in zip(sorted(whole, key=lambda r: (r.doc_id is None, r.doc_id, r.n_words)), [t for _, t in sorted(((r[0], r[1]) for r in tricky_rows), key=lambda x: (x[0] is None, x[0], len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))))]))


def test_empty(spark, empty):
    assert pr.run_digests(pr.find_runs(pr.with_planted_runs(empty))).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 12000 or text is null").collect()
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SMALL).collect()}
    assert all(got[d] == expected(d, t, plant=True) for d, t in docs)
    assert sum(got[d][1] > 0 for d, _ in docs) >= len(docs) // 20
