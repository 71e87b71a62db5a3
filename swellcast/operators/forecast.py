"""Forecasters on long-form series ``(series_id, col, idx, value)``.

Naive (M1 last, M2 mean) and the per-column ensemble (M3) are grouped
aggregates - one map-side-combined pass - followed by an equi-join onto
the rows to predict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, IDX = "series_id", "idx"


def naive_fit(train_long: DataFrame, strategy: str, key: str = KEY, idx: str = IDX) -> DataFrame:
    """Fitted level per ``(series, col)``: ``last`` = value at the last train
    idx (M1), ``mean`` = mean of the train values (M2)."""
    v = F.col("value")
    if strategy == "last":
        level = F.max_by(v, F.when(v.isNotNull(), F.col(idx)))
    elif strategy == "mean":
        level = F.avg(v)
    else:
        raise ValueError(f"unknown naive strategy {strategy!r}")
    return train_long.groupBy(key, "col").agg(level.alias("level"),
                                              F.max(idx).alias("cutoff_idx"))


def ensemble_fit(train_long: DataFrame, strategies: dict[str, str], key: str = KEY,
                 idx: str = IDX) -> DataFrame:
    """M3: one naive forecaster per target column, results stacked."""
    parts = [naive_fit(train_long.where(F.col("col") == c), s, key, idx).withColumn("strategy", F.lit(s))
             for c, s in strategies.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def naive_predict(model: DataFrame, rows: DataFrame, key: str = KEY) -> DataFrame:
    """Predict ``yhat`` for the ``(series, col, idx)`` rows to forecast: the
    level is flat over the horizon."""
    return rows.join(model.select(key, "col", F.col("level").alias("yhat")), [key, "col"], "inner")
