import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from kinelake.llm import entry_queries
from kinelake.llm.near_dedup import near_groups
from kinelake.llm.quality_classifier import quality_scores
from kinelake.llm.quality_rules import quality_rules

from ..conftest import MEDIUM, SMALL
from .test_dedup import lower


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage keeps of the documents that the one before it kept."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, MEDIUM).write.parquet(str(root / str(k)))
        docs = spark.read.parquet(str(root / str(k)))
        out.append(docs)
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "exact dedup", "near dedup", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_each_stage_decides_as_its_operator(spark, stages):
    docs, good, scored, single, distinct, packed = stages
    assert ids(good) == ids(quality_rules(docs).where("kept"))
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    assert set(ids(good)) - set(ids(scored)) == set(ids(good)) & set(ids(quality_scores(docs, labels).where("predicted = 0")))
    best = {}
    for r in scored.select("doc_id", "text").collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert ids(single) == sorted(best.values())
    assert ids(distinct) == ids(near_groups(single).where("kept"))


def test_pieces_are_the_tokens_of_what_is_left(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = {r.doc_id: r.text for r in stages[4].select("doc_id", "text").collect()}
    lengths, by_sequence = {}, {}
    for r in stages[5].collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= -(-sum(lengths.values()) // 4096) + 1


def test_clean_labelled_documents_are_not_rejected(spark, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").where("quality = 1").collect()}
    before = set(ids(quality_rules(stages[0]).where("not base_failed"))) & good
    assert len(before & set(ids(stages[2]))) >= 0.99 * len(before)


def test_run_gives_what_the_stages_give(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, MEDIUM)) == key(stages[5])


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry_queries.oracle_sql()) <= set(names)


def test_tables_with_sql_agree_with_it(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in entry_queries.oracle_sql().items():
        df = entry_queries.queries()[name](spark, SMALL)
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cur.fetchall())), name


def test_empty_documents_pass_through(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_packed_checksums(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    import numpy as np

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in entry_queries.op4_packing(spark, SMALL).where(F.col("piece") == 0).collect():
        own = [*lib.encode(text[r.doc_id], add_special_tokens=False).ids, 1][:4096]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def test_later_stages_do_not_read_the_documents_table(spark, tmp_path, stages):
    import shutil

    tables = tmp_path / "tables"
    tables.mkdir()
    for name in ("documents", "labels"):
        shutil.copy(f"{MEDIUM}/{name}.parquet", tables / f"{name}.parquet")
    docs = spark.read.parquet(str(tables / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tables)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if not k:
            (tables / "documents.parquet").unlink()
    assert docs.count() == stages[-1].count()
