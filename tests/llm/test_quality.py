import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinelake.llm import quality_classifier as qc
from kinelake.llm import quality_rules as qr

from ..conftest import MEDIUM
from .conftest import SCHEMA, prose


def counts_of(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_counts_and_base_rules(tricky, tricky_rows):
    got = sorted(((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in qr.COUNTS), r.base_failed) for r in qr.quality_rules(tricky).collect()))
    want = []
    for doc, text, *_ in tricky_rows:
        n = counts_of(text)
        want.append((doc if doc is not None else -1, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert got == sorted(want)


def test_rejected_rows_are_base_failures_or_unlikely(tricky):
    for r in qr.quality_rules(tricky).collect():
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)
        assert 0 <= r.p_good <= 1


def test_dropping_agrees_with_the_verdicts(tricky):
    out = qr.drop_low_quality(tricky)
    assert out.columns == tricky.columns
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in qr.quality_rules(tricky).where("kept").collect())
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == kept


def test_empty_table(empty):
    assert qr.quality_rules(empty).collect() == []
    assert qr.drop_low_quality(empty).collect() == []


def test_the_posterior_decides_and_keeps_clean_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = [r for r in qr.quality_rules(docs).collect() if not r.base_failed]
    clean = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    junk = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(junk) <= 0.02 * len(junk)
    counted = qr.with_counts(docs).where("not (" + qr.BASE_FAILED.format("_q") + ")")
    model = qr.learn(counted)
    assert model.converged
    judged = qr.verdict(counted, model).select("kept", *[v.alias(k) for k, v in qr.votes().items()]).collect()
    assert any(r.kept and 0 in r[1:] for r in judged), "a bad vote is never outvoted"


def planted(rng, n, good_share, on_good, on_bad):
    """Vote patterns of rules with known chances of (bad, good, no) votes."""
    out = Counter()
    for _ in range(n):
        table = on_good if rng.random() < good_share else on_bad
        out[tuple(rng.choices([0, 1, None], w)[0] for w in table)] += 1
    return out


ON_GOOD = [(0.01, 0.95, 0.04), (0.02, 0.9, 0.08), (0.01, 0.98, 0.01), (0.3, 0.6, 0.1)]
ON_BAD = [(0.8, 0.1, 0.1), (0.7, 0.2, 0.1), (0.9, 0.05, 0.05), (0.4, 0.5, 0.1)]


def test_em_recovers_planted_accuracies():
    patterns = planted(random.Random(1), 20000, 0.85, ON_GOOD, ON_BAD)
    model = qr.fit_label_model(list(patterns.items()), list("abcd"))
    assert model.converged and model.prior == pytest.approx(0.85, abs=0.02)
    for k, name in enumerate("abcd"):
        assert model.good[name] == pytest.approx(ON_GOOD[k], abs=0.02)
        assert model.bad[name] == pytest.approx(ON_BAD[k], abs=0.05)


def posterior(model, votes):
    odds = np.log(model.prior / (1 - model.prior)) + sum(model.weights(n)[{0: 0, 1: 1, None: 2}[v]] for n, v in zip(model.good, votes))
    return 1 / (1 + np.exp(-odds))


def test_the_verdict_is_not_all_must_pass():
    model = qr.fit_label_model(list(planted(random.Random(2), 20000, 0.85, ON_GOOD, ON_BAD).items()), list("abcd"))
    assert posterior(model, (1, 1, 1, 0)) > 0.95  # the fourth rule often errs: outvoted
    assert posterior(model, (0, 0, 0, 1)) < 0.05
    assert posterior(model, (None, None, None, None)) < posterior(model, (1, 1, 1, 0))
    unsure = [(0.0, 0.95, 0.05)] * 3
    silent = [(0.1, 0.1, 0.8)] * 3
    model = qr.fit_label_model(list(planted(random.Random(3), 20000, 0.7, unsure, silent).items()), list("abc"))
    assert posterior(model, (None, None, None)) < 0.5  # rejected without a bad vote


def test_em_over_patterns_is_em_over_documents():
    patterns = planted(random.Random(5), 400, 0.8, ON_GOOD, ON_BAD)
    model = qr.fit_label_model(list(patterns.items()), list("abcd"))
    rows = [votes for votes, n in patterns.items() for _ in range(n)]
    kinds = (0, 1, None)
    share, theta = 0.8, {c: [[x / 10 for x in prior] for _ in "abcd"] for c, prior in ((1, qr.GOOD_VOTES), (0, qr.BAD_VOTES))}
    for _ in range(3000):
        found = []
        for votes in rows:
            g, b = share, 1 - share
            for k, v in enumerate(votes):
                g, b = g * theta[1][k][kinds.index(v)], b * theta[0][k][kinds.index(v)]
            found.append(g / (g + b))
        old = share
        share = (sum(found) + qr.KINDS[0]) / (len(rows) + sum(qr.KINDS))
        for c, prior in ((1, qr.GOOD_VOTES), (0, qr.BAD_VOTES)):
            weight = [p if c else 1 - p for p in found]
            theta[c] = [[(sum(w for w, votes in zip(weight, rows) if votes[k] == v) + prior[j]) / (sum(weight) + 10) for j, v in enumerate(kinds)] for k in range(4)]
        if abs(share - old) < 1e-10:
            break
    assert model.prior == pytest.approx(share, abs=1e-6)
    for k, name in enumerate("abcd"):
        assert model.good[name] == pytest.approx(theta[1][k], abs=1e-6) and model.bad[name] == pytest.approx(theta[0][k], abs=1e-6)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0) + (None,) * 9 for i, t in rows], SCHEMA)


def test_classifier_on_held_out_rows(spark):
    scores = {r.doc_id: r for r in qc.quality_scores(spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(scores[i].held_out for i in held) and sum(r.held_out for r in scores.values()) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in scores)
    right = sum(scores[i].predicted == labels[i] for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())


def test_held_out_labels_never_matter(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    one, two = qc.learn(docs, labels), qc.learn(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and one.slope == two.slope


def test_classifier_edges(spark, tricky, tricky_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.score == pytest.approx(0.5) for r in qc.quality_scores(tricky, none).collect())
    ones = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None)], "doc_id long, quality int")
    rows = qc.quality_scores(tricky, ones).collect()
    assert len(rows) == len(tricky_rows) and all(r.predicted == 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert qc.quality_scores(empty, ones).collect() == []
    assert qc.drop_rejected(tricky, tricky, ones).columns == tricky.columns


def test_equal_texts_score_the_same_and_metadata_is_no_input(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80) if i % 3 else "bad " * 60) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(1, 0)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    other = docs_of(spark, [(i + 1000, t) for i, t in rows])
    model = qc.learn(docs, labels)
    one = [r[0] for r in docs.orderBy("doc_id").select(qc.score(docs, model)).collect()]
    two = [r[0] for r in other.orderBy("doc_id").select(qc.score(other, model)).collect()]
    assert one == two
    assert np.mean([s >= 0.3 for (i, _), s in zip(rows, one) if i % 3]) == 1.0
    assert np.mean([s < 0.3 for (i, _), s in zip(rows, one) if i % 3 == 0]) == 1.0


def test_dual_descent_against_the_primal_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.uint32) for _ in range(80)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    values = [np.ones(len(r), np.float32) / np.sqrt(len(r)) for r in rows]
    w, b = qc.dual_descent(rows, values, y, (1.0, 1.0), epochs=400)

    def primal(w, b):
        s = np.where(y > 0, 1, -1) * np.array([w[r] @ v + b for r, v in zip(rows, values)])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - s).sum()

    best = primal(w, b)
    for _ in range(300):
        d = np.zeros_like(w)
        d[:30] = rng.normal(0, 0.02, 30)
        assert primal(w + d, b + rng.normal(0, 0.02)) >= best - 0.02


def test_indicators_against_brute_force():
    """The same hashes, one n-gram at a time."""
    low = (1 << 64) - 1
    a, b, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9

    def place(x):
        x &= low
        return (((x ^ (x >> 29)) * b & low) >> 44) & (qc.DIMS - 1)

    long_word = "aB1" * 40
    for text in ("One two two THREE 4x!", "", "solo", f"{long_word} {long_word}x -- --", "é É 12 ß"):
        words = text.split()
        names = [qc.xxh32_intdigest(w.lower().encode()) for w in words]
        forms = [qc.xxh32_intdigest(qc.shape(w).encode(), 1) for w in words]
        forms = [qc.AGAIN if k and names[k] == names[k - 1] else f for k, f in enumerate(forms)]
        edged = [qc.EDGE, *forms, qc.EDGE]
        want = {place(w * a + 1) for w in names} | {place(f * b + 2) for f in edged if words}
        want |= {place(x * a + y * b + 3) for x, y in zip(edged, edged[1:]) if words}
        want |= {place((x * a + y * b) * c + z * a + 4) for x, y, z in zip(edged, edged[1:], edged[2:])}
        assert qc.indicators(text).tolist() == sorted(want)
    assert qc.shape(long_word) != qc.shape(long_word + "x!")
