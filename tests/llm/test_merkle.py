"""The manifest against trees built in one place, with many small partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinelake.llm import merkle
from kinelake.llm.entry_queries import oracle_sql

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, part int, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i // 3 * 3
        out.append((nodes[first:i], nodes[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[s]]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            proof = path(trees[k], i) + path(top, k)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], tuple(("".join(a), "".join(b)) for a, b in proof)))
    return sorted(out, key=str)


def rows_of(rng, n, sources):
    return [(i if rng.random() < 0.9 else rng.choice([None, 1, 2]), rng.choice(sources), rng.choice([None, "en"]), i, rng.choice([None, "", "a\nb", f"é{i}", "x" * 5000])) for i in range(n)]


def collected(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((bytes(s.before).hex(), bytes(s.after).hex()) for s in r.proof)) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,sources,step,few_tops", [(1, ["a"], 7, 4096), (3, [None], 7, 4096), (400, ["hot"] * 20 + [None, "", "é", "z"], 2, 0), (300, [f"s{i}" for i in range(200)], 2, 4096), (260, ["one"], 3, 0)])
def test_like_trees_in_one_place(spark, monkeypatch, n, sources, step, few_tops):
    for name, value in (("LEAVES", 40), ("FEW_LEAVES", 10), ("STEP", step), ("FEW_TOPS", few_tops)):
        monkeypatch.setattr(merkle, name, value)
    rows = rows_of(random.Random(n), n, sources)
    rows += rows[:3]
    docs = spark.createDataFrame([(*r, "g", 1, "l") for r in rows], SCHEMA).repartition(3)
    told = merkle.manifest(docs, FIELDS, "source", "doc_id", held=F.col("n_chars")).cache()
    assert collected(told) == brute(rows)
    assert told.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert sorted(r.held for r in told.collect()) == sorted(r[3] for r in rows)


def test_other_leaf_is_found_out(spark):
    rows = rows_of(random.Random(2), 40, ["a", "b"])
    told = merkle.manifest(spark.createDataFrame([(*r, "g", 1, "l") for r in rows], SCHEMA), FIELDS)
    forged = F.sha2(F.col("leaf"), 256)
    assert told.where(merkle.fold(forged, F.col("proof")) == F.col("root")).count() == 0


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS).collect() == []


def test_stretches_cover_their_leaves():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(1, 80)
        begin = rng.randrange(total)
        n = rng.randrange(1, total - begin + 1)
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(total)]
        tree = levels([x.hex() for x in leaves])
        got = merkle.Stretch(begin, leaves[begin : begin + n], total)
        tops = list(got.tops())
        assert all(tree[level][place] == digest.hex() for level, place, digest in tops)
        covered = sorted(i for level, place, _ in tops for i in range(place * 3**level, min(total, (place + 1) * 3**level)))
        assert covered == list(range(begin, begin + n))
        paths, number = got.proofs()
        for i, (steps, top) in enumerate(zip(paths, number)):
            node = leaves[begin + i]
            for before, after in steps:
                node = hashlib.sha256((before + node + after).hex().encode()).digest()
            assert node == tops[top][2] and len(steps) == tops[top][0]


def test_crc_in_sql():
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents as select i as doc_id, 's' || i % 3 as source, null as lang, i as n_chars, 'a' || chr(10) || i as text from range(50) t(i)")
    rows = con.execute(oracle_sql()["op13_merkle_manifest"]).fetchall()
    assert {r[0] for r in rows if not r[-1]} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 2 == 0}
    want = brute([(i, f"s{i % 3}", None, i, f"a\n{i}") for i in range(50)])
    assert sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=str) == sorted((w[:4] for w in want), key=str)
