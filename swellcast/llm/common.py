"""Helpers shared by the corpus operators: shared-folder tables, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: computed once, survives lost executors, prunes columns on re-read.
    The folder is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under the names ``id`` and
    ``text``: other columns of the caller can never clash with ours."""
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of at most ``max_bytes`` of text (a longer
    single text is a run of its own), so a task's memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            limit = (ends[lo - 1] if lo else 0) + max_bytes
            hi = max(lo + 1, int(np.searchsorted(ends, limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    return [t or "" for t in batch.column(col).to_pylist()]
