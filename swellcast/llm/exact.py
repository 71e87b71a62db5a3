"""Exact deduplication with static binary-fuse filters.

Documents arrive in batches. Each earlier batch is an immutable snapshot: its
distinct digests are split into hash buckets of bounded size and every bucket
gets one binary-fuse filter. The digests of the new batch are screened bucket
by bucket against the filters of all snapshots. Positives (true or false) go
on to the exact buckets, where whole texts are compared; negatives are proven
new and only meet each other. Digests repeated inside a batch are grouped
apart and byte-checked the same way.

Hot groups: digests are counted with map-side aggregation, texts are compared
as ``GROUP BY digest, salt, text`` before the salts meet, and rows find their
group in a plain join that adaptive execution can split.

Defined results: null text counts as empty; equal means byte-equal; of a group
the largest id stays; a null id is smaller than any other; rows that repeat id
and text count as rows of the group and only the first of them is kept; other
columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stored
from .fuse import build, contains

KEYS_PER_BUCKET = 50_000  # keys of one filter; a bucket's work stays in a small task
SALTS = 16

FILTER = "snapshot int, bucket long, seed int, seg int, count int, filter binary"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def filters(keys: DataFrame, buckets: int) -> DataFrame:
    """One binary-fuse filter per (snapshot, bucket) of distinct ``key`` values."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, count, table = build(np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64)))
        return pd.DataFrame([(pdf["snapshot"].iat[0], pdf["bucket"].iat[0], seed, seg, count, table)],
                            columns=["snapshot", "bucket", "seed", "seg", "count", "filter"])

    return (keys.select("snapshot", F.pmod("key", F.lit(buckets)).alias("bucket"), "key")
            .groupBy("snapshot", "bucket").applyInPandas(one, FILTER))


def screen(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """The ``key`` values that some filter of their bucket may contain."""

    def probe(mine: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        key = mine["key"].to_numpy(np.int64)
        hit = np.zeros(len(key), bool)
        for f in tables.itertuples():
            hit |= contains(key.view(np.uint64), f.seed, f.seg, f.count, f.filter)
        return pd.DataFrame({"key": key[hit]})

    return (keys.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "key").groupBy("bucket")
            .cogroup(index.groupBy("bucket")).applyInPandas(probe, "key long"))


def exact_dedup(docs: DataFrame, batch: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Group byte-equal texts. ``batch`` numbers the batches (0 came first; the
    largest is the new one, all below it are snapshots); without it ids are
    dealt over three batches by their crc32. The result does not depend on
    the batches nor, thanks to the byte checks, on the digest.

    Returns id, keep_id, group_size, kept, text_sha256, one row per input row.
    """
    if batch is None:
        batch = crc_mod(docs[id_col].cast("long"), 3)
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                       F.coalesce(batch.cast("int"), F.lit(0)).alias("batch"))
    base = base.withColumn("digest", digest(F.col("text")))
    rows = stored(base.select("id", "batch", "digest", sha256(F.col("text")).alias("text_sha256")), "digests")
    counted = stored(rows.groupBy("batch", "digest").agg(F.count(F.lit(1)).alias("n"))
                     .withColumn("key", F.xxhash64("digest")), "counted")
    size, newest = counted.agg(F.count(F.lit(1)), F.max("batch")).first()
    newest = newest or 0
    buckets = max(1, -(-size // KEYS_PER_BUCKET) * 4)
    # every batch but the newest is a snapshot; each later batch was new once, so
    # it is screened against the filters of the batches before it
    index = stored(filters(counted.where(F.col("batch") < newest).select(F.col("batch").alias("snapshot"), "key"),
                           buckets), "filters")
    positive = None
    for b in range(1, newest + 1):
        hit = screen(counted.where(F.col("batch") == b).select("key"), index.where(F.col("snapshot") < b), buckets)
        positive = hit if positive is None else positive.unionByName(hit)
    repeated = counted.where("n > 1").select("digest")
    if positive is not None:
        repeated = repeated.unionByName(counted.join(positive.distinct(), "key", "left_semi").select("digest"))
    check = repeated.distinct().select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    texts = stored(salted.join(check, ["digest", "salt"], "left_semi")
                   .groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
                   .groupBy("digest", "text").agg(F.max("id").alias("keep"), F.sum("n").alias("size")), "bytes")
    per_digest = texts.groupBy("digest").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"),
                                             F.count(F.lit(1)).alias("variants"))
    mixed = stored(texts.join(per_digest.where("variants > 1"), "digest", "left_semi"), "mixed")
    plain = per_digest.where("variants = 1").select("digest", "keep", "size")
    same = rows.groupBy("id", "digest", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("times"))
    if not mixed.isEmpty():  # different texts under one digest: rows find their group by the text itself
        odd = (base.join(mixed, ["digest", "text"]).groupBy("id", "digest", "text", "keep", "size")
               .agg(F.count(F.lit(1)).cast("int").alias("times"))
               .select("id", "digest", sha256(F.col("text")).alias("text_sha256"), "times", "keep", "size"))
        same = same.join(mixed.select("digest").distinct(), "digest", "left_anti")
        found = same.join(plain, "digest", "left").select("id", "digest", "text_sha256", "times", "keep", "size").unionByName(odd)
    else:
        found = same.join(plain, "digest", "left").select("id", "digest", "text_sha256", "times", "keep", "size")
    return (found.select("id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                         F.coalesce("size", F.col("times").cast("long")).alias("group_size"), "text_sha256",
                         F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
