"""Registered queries: file scans and sinks round-tripped through the
shared checkpoint folder (the data written is derived from the given tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import text
from . import views
from .oracles import rnd
from .queries import register
from .views import DAILY_SQL, MET_SQL

RAW = ["WDIR", "WSPD", "GST", "WVHT", "DPD", "APD", "MWD", "PRES", "ATMP", "WTMP", "DEWP", "VIS", "TIDE"]


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/swellcast-{name}-{uuid.uuid4().hex}"


@register("s1_buoy_scan", f"WITH met AS ({MET_SQL})\nSELECT series_id, date_trunc('minute', ts) AS ts, "
          + ", ".join(rnd(c, c) for c in RAW) + " FROM met")
def s1_buoy_scan(spark, sf):
    """Write the buoy-like view as one blank-delimited text file per series
    (two '#' header lines), then parse the files back with the buoy scanner."""
    path = scratch(spark, "buoy")
    text.write_buoy(views.met(spark, sf), path, RAW)
    return text.read_buoy(spark, f"{path}/*/*/*.txt", series_pattern=r"series_id=([^/]+)/")


@register("s2_dated_csv", f"""WITH daily AS ({DAILY_SQL})
SELECT series_id, d AS Date, {rnd('value', 'value')} FROM daily""")
def s2_dated_csv(spark, sf):
    """Write the daily series as dated CSV (S3 sink, one folder per series),
    read it back with the dated-CSV scanner (S2)."""
    path = scratch(spark, "csv")
    d = views.daily(spark, sf).select("series_id", F.col("d").alias("Date"), "value")
    d.write.mode("errorifexists").partitionBy("series_id").option("header", True).csv(path)
    back = text.read_dated_csv(spark, path, ["value"])  # series_id from partition discovery
    return back.select(F.col("series_id").cast("string"), "Date", "value")


def _p15_sql():
    from .q_windows import _filled, _round_all, _scaler_sql
    from ..config import TARGETS
    return _filled() + _scaler_sql(TARGETS) + f"\nSELECT series_id, ts, idx, is_test, {_round_all(TARGETS)} FROM scaled"


@register("s6_scaler_state", _p15_sql())
def s6_scaler_state(spark, sf):
    """Fit the target scaler on train rows, save its state table, load it
    back (a second call reuses it) and apply it: equals P15."""
    from ..config import HORIZON, TARGETS
    from ..operators.blocks import train_test_split
    from ..operators.scaling import apply_scaler, fingerprint, fit_or_load_scaler, state_path
    from . import bases
    f = bases.targets_filled(spark, sf)
    sp = train_test_split(f, HORIZON * 3)
    train = sp.where(~F.col("is_test"))
    path = state_path(scratch(spark, "state"), TARGETS, fingerprint(train, TARGETS, ["series_id", "ts"]))
    fit_or_load_scaler(train, TARGETS, path)
    state = fit_or_load_scaler(train, TARGETS, path)   # reused, not refitted
    return apply_scaler(sp, state, TARGETS).select("series_id", "ts", "idx", "is_test", *TARGETS)


def _m10_sql():
    from .q_forecast import _cv_sql
    return _cv_sql() + f"\nSELECT series_id, fold_id, col, metric, {rnd('value', 'value')} FROM fsl"


@register("s7_cv_results", _m10_sql())
def s7_cv_results(spark, sf):
    """Write the CV fold scores as a Parquet table partitioned by metric,
    read it back."""
    from .q_forecast import cv_scores
    path = scratch(spark, "cv")
    cv_scores(spark, sf).write.mode("errorifexists").partitionBy("metric").parquet(path)
    back = spark.read.parquet(path)
    return back.select("series_id", "fold_id", "col", F.col("metric").cast("string"), "value")
