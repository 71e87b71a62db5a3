"""Registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, html, langid, lm, near, packing, repair, shards, simhash, substring, urls, whiten
from .common import crc_mod, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_with_edits(read(spark, sf_dir, "documents"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op3_exact_dedup", exact.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


@query("op4_minhash", near.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(read(spark, sf_dir, "documents"))


@query("op5_langid")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_urls")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


@query("op7_substring", substring.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


@query("op8_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    docs = read(spark, sf_dir, "documents")
    scored = lm.score_documents(docs, ~held_out)
    return scored.withColumn("held_out", held_out)


@query("op9_html")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten_table(read(spark, sf_dir, "embeddings"))


@query("op12_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(read(spark, sf_dir, "conversations"))


@query("op13_token_shards")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_and_read(read(spark, sf_dir, "documents"), tokenizer_path())
