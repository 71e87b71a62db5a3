"""Shared derived inputs for the registered queries: lazy frames, so that a
query's filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLEAN_COLUMNS, HORIZON, TARGETS
from ..operators.blocks import train_test_split
from ..operators.clean import preprocess
from ..operators.grid import hourly_mean
from ..operators.windows import ffill
from . import views

# The given series are short: with chunks of a week every registered window,
# fill and running sum crosses chunk borders, so the comparison with DuckDB
# covers halo and carry. The operators' own default is CHUNK (a year).
QUERY_CHUNK = 168


def met_hourly(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    """P19 grid: ``(series_id, ts, idx, WSPD ... MWD_cos)``."""
    return preprocess(views.met(spark, sf_dir), chunk=chunk)


def met_filled(spark: SparkSession, sf_dir: str, cols: list[str] | None = None,
               chunk: int = QUERY_CHUNK) -> DataFrame:
    """``hourly_filled``: P19 grid, W7 forward fill (+ leading back-fill)."""
    cols = cols or CLEAN_COLUMNS
    g = met_hourly(spark, sf_dir, chunk).select("series_id", "ts", "idx", *cols)
    return ffill(g, cols, chunk=chunk)


def targets_filled(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    return met_filled(spark, sf_dir, TARGETS, chunk)


def targets_train(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    """The filled targets before the hold-out (T1): all that cross-validation
    may see. Filling runs forward, so it takes nothing from the hold-out."""
    f = train_test_split(targets_filled(spark, sf_dir, chunk), 3 * HORIZON)
    return f.where(~F.col("is_test")).drop("n_rows", "test_start", "is_test")


def obs_hourly(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    return hourly_mean(views.obs(spark, sf_dir), ["value"], chunk=chunk)


def obs_filled(spark: SparkSession, sf_dir: str, chunk: int = QUERY_CHUNK) -> DataFrame:
    return ffill(obs_hourly(spark, sf_dir, chunk), ["value"], chunk=chunk)
