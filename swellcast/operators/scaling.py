"""Standard scaling fitted on train rows (P15), its inverse (P16), max
normalisation (P12). State is a small table ``(series_id, col, mean, std)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "series_id"


def _stack(cols: list[str]) -> Column:
    """``stack`` expression turning wide columns into (col, value) rows."""
    parts = ", ".join(f"'{c}', `{c}`" for c in cols)
    return F.expr(f"stack({len(cols)}, {parts}) as (col, value)")


def to_long(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """Unpivot ``cols`` into ``(col, value)`` rows (``series_long``)."""
    return df.select(*keep, _stack(cols))


def fit_scaler(df: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    """Fit: population mean and std per series and column (sklearn's
    StandardScaler divides by the n std); std 0 or undefined -> 1."""
    wide = df.groupBy(key).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    parts = ", ".join(f"'{c}', `_m_{c}`, `_s_{c}`" for c in cols)  # only the one state row a series is unpivoted
    return wide.select(key, F.expr(f"stack({len(cols)}, {parts}) as (col, mean, _sd)")).select(
        key, "col", "mean", F.when(F.col("_sd").isNull() | (F.col("_sd") == 0.0), F.lit(1.0)).otherwise(F.col("_sd")).alias("std"))


def _wide_state(state: DataFrame, cols: list[str], key: str) -> DataFrame:
    """One row per series with ``_m_c`` / ``_s_c`` per column (small; AQE
    broadcasts it on measured size)."""
    aggs = []
    for c in cols:
        aggs.append(F.max(F.when(F.col("col") == c, F.col("mean"))).alias(f"_m_{c}"))
        aggs.append(F.max(F.when(F.col("col") == c, F.col("std"))).alias(f"_s_{c}"))
    return state.groupBy(key).agg(*aggs)


def apply_scaler(df: DataFrame, state: DataFrame, cols: list[str], key: str = KEY,
                 inverse: bool = False) -> DataFrame:
    """P15 ``(x-mean)/std``; with ``inverse`` P16 ``x*std+mean``."""
    st = _wide_state(state, cols, key)
    x = df.join(st, key, "left")
    if inverse:
        rep = {c: F.col(c) * F.col(f"_s_{c}") + F.col(f"_m_{c}") for c in cols}
    else:
        rep = {c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols}
    return x.withColumns(rep).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def normalise_by_max(df: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    """``c / max(c)`` per series; a zero maximum gives NULL."""
    mx = df.groupBy(key).agg(*[F.max(c).alias(f"_mx_{c}") for c in cols])
    x = df.join(mx, key, "left")
    return x.withColumns({c: F.col(c) / F.nullif(F.col(f"_mx_{c}"), F.lit(0.0)) for c in cols}) \
        .drop(*[f"_mx_{c}" for c in cols])


def unscale_long(df: DataFrame, state: DataFrame, value: str, key: str = KEY) -> DataFrame:
    """P16 on long rows ``(key, col, ..., value)``: ``value*std + mean``."""
    st = state.select(key, "col", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    return df.join(st, [key, "col"], "left") \
        .withColumn(value, F.col(value) * F.col("_s") + F.col("_m")).drop("_m", "_s")


def fingerprint(df: DataFrame, cols: list[str], keys: list[str]) -> str:
    """Fingerprint of the rows that a state is fitted on: their number and two
    sums of row hashes over keys and columns, whatever their order or
    partitioning. One map-side-combined pass."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *keys, *cols).cast("decimal(20,0)"))
    r = df.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(2).alias("b")).first()
    return f"{r['n']}|{r['a']}|{r['b']}"


def state_path(base: str, cols: list[str], fingerprint: str = "") -> str:
    """S6 key: the state folder is named by a hash of the columns and the
    :func:`fingerprint` of the fitted rows, so a changed input never reuses a
    stale state (the reference reuses whatever file exists)."""
    import hashlib
    h = hashlib.sha1(("|".join(cols) + "#" + fingerprint).encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/scaler-{h}"


def fit_or_load_scaler(df: DataFrame, cols: list[str], path: str, key: str = KEY) -> DataFrame:
    """Reuse the saved scaler state at ``path`` if it was written whole, else
    fit on ``df``, save it as Parquet and return what was written. A folder that
    an ended job left incomplete is written anew; an unreadable one is an error."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        fit_scaler(df, cols, key).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
