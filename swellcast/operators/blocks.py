"""Temporal split (T1), test blocks (W14), sliding-window CV folds (J7),
block context rows (J9). All arithmetic on ``idx``: no global sort, no
theta join - each row explodes into the few folds / blocks holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, IDX = "series_id", "idx"


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("long")


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def series_length(df: DataFrame, key: str = KEY, idx: str = IDX) -> DataFrame:
    """``(key, n_rows)`` per series on a gap-free grid (max idx + 1); one row
    per series, computed with map-side partial aggregation."""
    return df.groupBy(key).agg((F.max(idx) + 1).alias("n_rows"))


def train_test_split(df: DataFrame, test_size: int, key: str = KEY, idx: str = IDX) -> DataFrame:
    """The last ``test_size`` rows of each series are test.
    Adds ``n_rows``, ``test_start`` and ``is_test``. A series that would keep no
    train row is an error."""
    short = F.raise_error(F.concat(F.lit("series "), F.col(key).cast("string"), F.lit(" has "), F.col("n_rows").cast("string"),
                                   F.lit(f" rows, too few for {test_size} test rows"))).cast("long")
    x = df.join(series_length(df, key, idx), key, "inner")
    return x.withColumn("test_start", F.when(F.col("n_rows") > test_size, F.col("n_rows") - F.lit(test_size)).otherwise(short)) \
        .withColumn("is_test", F.col(idx) >= F.col("test_start"))


def assign_blocks(df: DataFrame, horizon: int, idx: str = IDX) -> DataFrame:
    """W14 on a frame from :func:`train_test_split`: consecutive blocks of
    ``horizon`` test rows, numbered from 1; an incomplete last block is
    dropped (its rows get NULL). Adds ``block_id`` and ``n_blocks``."""
    n_blocks = _floor_div(F.col("n_rows") - F.col("test_start"), horizon)
    b = _floor_div(F.col(idx) - F.col("test_start"), horizon) + 1
    return df.withColumn("n_blocks", n_blocks) \
        .withColumn("block_id", F.when(F.col("is_test") & (b <= F.col("n_blocks")), b))


def n_folds(n: Column, window: int, horizon: int, step: int) -> Column:
    """``floor((n - h - w) / s) + 1`` (0 when the series is too short)."""
    return F.greatest(_floor_div(n - F.lit(horizon + window), step) + 1, F.lit(0).cast("long"))


def sliding_folds(df: DataFrame, window: int, horizon: int, step: int,
                  key: str = KEY, idx: str = IDX) -> DataFrame:
    """Sliding-window splitter. Fold ``k`` trains on rows
    ``[k*s, k*s+w)`` and tests on the next ``h`` rows. Each row is exploded
    to the folds containing it (``role`` = 'train' / 'test', ``step`` =
    1..h on test rows) by arithmetic bounds - an equi-explode."""
    n = series_length(df, key, idx)
    x = df.join(n, key, "inner").withColumn("_k", n_folds(F.col("n_rows"), window, horizon, step))
    i = F.col(idx)
    zero = F.lit(0).cast("long")
    tr_lo = F.greatest(_ceil_div(i - F.lit(window - 1), step), zero)
    tr_hi = F.least(_floor_div(i, step), F.col("_k") - 1)
    te_lo = F.greatest(_ceil_div(i - F.lit(window + horizon - 1), step), zero)
    te_hi = F.least(_floor_div(i - F.lit(window), step), F.col("_k") - 1)
    train = x.where(tr_lo <= tr_hi).withColumn("fold_id", F.explode(F.sequence(tr_lo, tr_hi))) \
        .withColumn("role", F.lit("train")).withColumn("step", F.lit(None).cast("long"))
    test = x.where((i >= window) & (te_lo <= te_hi)) \
        .withColumn("fold_id", F.explode(F.sequence(te_lo, te_hi))) \
        .withColumn("role", F.lit("test")) \
        .withColumn("step", i - (F.col("fold_id") * step + window) + 1)
    return train.unionByName(test).drop("_k")


def fold_table(df: DataFrame, window: int, horizon: int, step: int,
               key: str = KEY, idx: str = IDX) -> DataFrame:
    """Fold bounds per series: ``(key, fold_id, train_start_idx,
    train_end_idx, test_start_idx, test_end_idx)`` (inclusive ends)."""
    n = series_length(df, key, idx).withColumn("_k", n_folds(F.col("n_rows"), window, horizon, step))
    f = n.where(F.col("_k") > 0).select(
        key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("fold_id"))
    s = F.col("fold_id") * step
    return f.select(key, "fold_id", s.alias("train_start_idx"),
                    (s + window - 1).alias("train_end_idx"),
                    (s + window).alias("test_start_idx"),
                    (s + window + horizon - 1).alias("test_end_idx"))


def context_rows(df: DataFrame, before: int, horizon: int, idx: str = IDX) -> DataFrame:
    """Rows ``[block_start - before, block_start - 1]`` for every block of
    a frame from :func:`assign_blocks` (``n_blocks`` / ``test_start`` set),
    tagged with the ``block_id`` they give context to."""
    i = F.col(idx)
    ts0 = F.col("test_start")
    lo = F.greatest(_ceil_div(i + 1 - ts0, horizon), F.lit(0).cast("long"))
    hi = F.least(_floor_div(i + F.lit(before) - ts0, horizon), F.col("n_blocks") - 1)
    x = df.where(lo <= hi).withColumn("_b0", F.explode(F.sequence(lo, hi)))
    return x.withColumn("ctx_block_id", F.col("_b0") + 1).drop("_b0")
