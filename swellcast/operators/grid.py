"""Regular grids: hourly resample (A1), re-index on a spine (J1), step inference.

Grid rows carry ``idx`` = whole steps since the series' first step, computed
arithmetically from the timestamp, so later lags, splits, blocks and folds
are equi-joins or plain arithmetic instead of global sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK
from ..functions.exprs import hour_floor, hour_number, hour_ts


def spine(bounds: DataFrame, key: str, lo: str, hi: str, chunk: int = CHUNK) -> DataFrame:
    """Every unit ``lo..hi`` per series as ``(key, _unit, idx)``.

    Generated in two explodes (chunk ids, then units inside the chunk) so a
    series spanning many units produces its spine as many small arrays rather
    than one huge one.
    """
    span = F.col(hi) - F.col(lo)
    chunks = bounds.select(
        key, lo, hi,
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(span / chunk))).alias("_c"))
    first = F.col("_c") * chunk
    last = F.least(first + (chunk - 1), span)
    steps = chunks.select(key, F.col(lo).alias("_lo"),
                          F.explode(F.sequence(first, last)).alias("idx"))
    return steps.select(key, (F.col("_lo") + F.col("idx")).alias("_unit"), "idx")


def reindex(values: DataFrame, key: str, unit: str, cols: list[str],
            chunk: int = CHUNK, bounds: DataFrame | None = None) -> DataFrame:
    """Left-join ``values`` (one row per ``(key, unit)``) onto a gap-free
    spine from each series' first to last unit. Missing units get NULLs.

    Both join inputs are hash-partitioned on ``(key, unit)``; when ``values``
    comes from a ``groupBy(key, unit)`` the aggregate's partitioning is reused
    and only the spine is shuffled. ``bounds`` ``(key, _lo, _hi)`` overrides
    the observed range (used by sliced grids).
    """
    if bounds is None:
        bounds = values.groupBy(key).agg(F.min(unit).alias("_lo"), F.max(unit).alias("_hi"))
    sp = spine(bounds, key, "_lo", "_hi", chunk).withColumnRenamed("_unit", unit)
    return sp.join(values.select(key, unit, *cols), [key, unit], "left")


def hourly_mean(df: DataFrame, cols: list[str], key: str = "series_id",
                ts: str = "ts", chunk: int = CHUNK, bounds: DataFrame | None = None) -> DataFrame:
    """A1: ``resample('H').mean()`` per series.

    Left-closed, left-labelled hours; the mean skips NULLs; every hour between
    the first and last observed hour is present, empty ones as NULL rows.
    Output ``(key, ts, idx, *cols)``; partial aggregation happens map-side.
    """
    binned = df.select(key, hour_number(hour_floor(ts)).alias("_hr"), *cols)
    agg = binned.groupBy(key, "_hr").agg(*[F.avg(c).alias(c) for c in cols])
    grid = reindex(agg, key, "_hr", cols, chunk, bounds)
    return grid.select(key, hour_ts("_hr").alias("ts"), "idx", *cols)


def hourly_mean_sliced(df: DataFrame, cols: list[str], start, end, key: str = "series_id",
                       ts: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """P6 applied before A1, with the same rows as slicing the full grid.

    The slice filter reaches the Parquet scan for the value columns; the
    spine still runs over the series' full hourly range clipped to the
    slice (a second scan reads only ``key`` and ``ts``). ``idx`` stays
    relative to the series' first hour. ``start`` / ``end`` are TIMESTAMP_NTZ
    columns, ``end`` exclusive.
    """
    hr = hour_number(hour_floor(ts))
    full = df.select(key, hr.alias("_hr")).groupBy(key).agg(F.min("_hr").alias("_f"), F.max("_hr").alias("_l"))
    s_hr = F.ceil(F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), start) / 60.0)
    e_hr = F.ceil(F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), end) / 60.0) - 1
    bounds = full.select(key, "_f", F.greatest(F.col("_f"), s_hr).alias("_lo"), F.least(F.col("_l"), e_hr).alias("_hi")) \
        .where(F.col("_lo") <= F.col("_hi"))
    rows = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    binned = rows.select(key, hr.alias("_hr"), *cols)
    agg = binned.groupBy(key, "_hr").agg(*[F.avg(c).alias(c) for c in cols])
    grid = reindex(agg, key, "_hr", cols, chunk, bounds.select(key, "_lo", "_hi"))
    grid = grid.join(bounds.select(key, "_f", "_lo"), key, "inner") \
        .withColumn("idx", F.col("idx") + F.col("_lo") - F.col("_f")).drop("_f", "_lo")
    return grid.select(key, hour_ts("_hr").alias("ts"), "idx", *cols)


def daily_grid(df: DataFrame, cols: list[str], key: str = "series_id", d: str = "d",
               chunk: int = CHUNK) -> DataFrame:
    """J1 on a daily index: one row per day from first to last day, gaps NULL."""
    units = df.select(key, F.datediff(F.col(d), F.lit("1970-01-01").cast("date")).alias("_day"), *cols)
    grid = reindex(units, key, "_day", cols, chunk)
    return grid.select(key, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day").cast("int")).alias(d),
                       "idx", *cols)


def infer_step(df: DataFrame, key: str = "series_id", ts: str = "ts",
               default_seconds: int = 3600, chunk_hours: int = CHUNK) -> DataFrame:
    """Sampling step per series, ``freq or infer_freq(idx) or 'H'``.

    Differences of consecutive distinct timestamps: inside a time chunk by a
    window, across chunk borders from a per-chunk (min, max) summary
    ("chunk + carry"), so no series is ordered in a single task. A constant
    difference is the step; anything else (or fewer than 3 points, where the
    frequency cannot be inferred) falls back to ``default_seconds``.
    """
    secs = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts)) \
        / F.lit(1_000_000)  # NTZ arithmetic: independent of the session time zone
    x = df.select(key, secs.alias("_s")).distinct() \
        .withColumn("_chunk", F.floor(F.col("_s") / (3600 * chunk_hours)))
    w = Window.partitionBy(key, "_chunk").orderBy("_s")
    inner = x.select(key, (F.col("_s") - F.lag("_s").over(w)).alias("_d"))
    summ = x.groupBy(key, "_chunk").agg(F.min("_s").alias("_mn"), F.max("_s").alias("_mx"),
                                        F.count("*").alias("_n"))
    wc = Window.partitionBy(key).orderBy("_chunk")
    border = summ.select(key, (F.col("_mn") - F.lag("_mx").over(wc)).alias("_d"))
    counts = summ.groupBy(key).agg(F.sum("_n").alias("n_points"))
    diffs = inner.unionByName(border).where(F.col("_d").isNotNull())
    stats = diffs.groupBy(key).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    out = counts.join(stats, key, "left")
    regular = (F.col("_lo") == F.col("_hi")) & (F.col("n_points") >= 3)
    return out.select(
        key,
        F.col("n_points"),
        regular.alias("inferred"),
        F.when(regular, F.col("_lo")).otherwise(F.lit(default_seconds)).cast("long").alias("step_seconds"),
    )


__all__ = ["spine", "reindex", "hourly_mean", "daily_grid", "infer_step"]
