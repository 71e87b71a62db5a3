"""Cleaning pipeline over ``documents``: five stages, each written as Parquet
and read again as the next one's input. All but the last keep the input's
columns; every stage works on all rows that the stage before kept.

Null ids, null and empty texts pass as the operators define: the language
stage drops texts without letters, exact copies without id are dropped like any
others, and rows that repeat id and text count as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swellcast.llm import exact, langid, near, packing, substring
from swellcast.llm.common import read, stored

MIN_LANGUAGE_SCORE = 0.4  # below, no language fits the text, nor do several fit its words


def _keep(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were kept; of rows that repeat id and text, one.
    A decision that names the text (``text_sha256``) holds for that text alone,
    so rows without id, or with a repeated one, are judged one by one; any other
    holds for all rows of the id."""
    kept = judged.where("kept").select(F.col("doc_id").alias("kept_id"), *(["text_sha256"] if "text_sha256" in judged.columns else [])).distinct()
    same = docs["doc_id"].eqNullSafe(kept["kept_id"])
    if "text_sha256" in kept.columns:
        same = same & (F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256) == kept["text_sha256"])
    out = docs.join(kept, same, "left_semi")
    if not judged.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which no learned language is found; those in
    several languages stay."""
    return langid.keep_identified(docs, langid.train(docs, F.lit(True)), MIN_LANGUAGE_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the one with the largest id, of equal texts."""
    return _keep(docs, stored(exact.exact_dedup(docs), "exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of near-duplicates. Rows that repeat
    an id are one document; rows without id are never near copies (their exact
    copies went before)."""
    return _keep(docs, stored(near.near_dedup(docs, percent=80), "near"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of repeated passages out of the texts that lost any; drop
    documents of which nothing is left."""
    cut = substring.remove_repeats(docs, keep_text=True).where("kept IS NOT NULL").select(
        F.col("doc_id").alias("cut_id"), F.col("tid").alias("cut_tid"), "kept").distinct()
    text = F.coalesce("kept", "text")
    rows = docs.join(cut, docs["doc_id"].eqNullSafe(cut["cut_id"]) & (F.hash(F.coalesce(docs["text"], F.lit(""))) == cut["cut_tid"]), "left")
    rows = rows.where("kept IS NULL OR kept <> ''")
    changed = {"text": text, "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*(changed.get(c, docs[c]).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into training sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", pack)]

# language identification is learned, so SQL cannot express the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
