"""The registered queries of this subpackage, one for each operator, and their DuckDB twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, langid, merkle, packing, periodic_runs, sharding, url_filter, warc
from .common import LOWER, UPPER, table
from .exact_dedup import exact_dedup
from .near_dedup import near_groups
from .quality_classifier import quality_scores
from .quality_rules import quality_rules

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path)
    back = bpe.decode(tokens, path)
    n_tokens = F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens")
    return back.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end=1)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.run_digests(periodic_runs.find_runs(docs, least=6, copies=4))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.read_back(chat_format.windows(turns, tokenizer_path()), together=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = F.translate("text", "\n", "")
    tampered = F.when(struck & (without != F.col("text")), F.unhex(merkle.leaf_digest(*[without if c == "text" else F.col(c) for c in fields])))
    told = merkle.manifest(docs, fields, "source", "doc_id", tampered=tampered)
    folded = merkle.fold(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("proof"))
    told = told.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Query]:
    found = [op1_bpe, op2_quality_classifier, op3_sharding, op4_packing, op5_exact_dedup, op6_url_filter, op7_near_dedup, op8_quality_rules, op9_warc, op10_language_id, op11_periodic_runs, op12_chat_formatting, op13_merkle_manifest]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": f"""
            with n as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents),
            g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from n group by 1)
            select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, n.text_sha256 from n join g using (text_sha256)
        """,
        "op13_merkle_manifest": merkle.oracle_sql(),
        "op3_sharding": sharding.oracle_sql(),
        "op9_warc": warc.oracle_sql(),
        "op6_url_filter": url_filter.oracle_sql(),
    }
