"""Parquet table scans and the NaN -> NULL rule applied at every scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of ``{sf_dir}/{name}.parquet``; column pruning and filter
    pushdown happen when later ``select``/``where`` calls reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(c: Column) -> Column:
    """pandas skips NaN in means; Spark's avg would return NaN. Convert once."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nans_to_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not cols:
        return df
    return df.withColumns({c: nan_to_null(F.col(c)) for c in cols})
