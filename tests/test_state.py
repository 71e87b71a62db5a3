"""Saved state, appended runs, array windows and refused splits."""

import os

import pytest
from pyspark.sql import functions as F

from swellcast.operators import windows
from swellcast.operators.blocks import train_test_split
from swellcast.operators.runs import log_runs, logged
from swellcast.operators.scaling import fingerprint, fit_or_load_scaler, state_path


def rows(spark, n=40, bump=0.0):
    return spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").alias("idx"), (F.col("id") * 1.5 + bump).alias("v"))


def test_fingerprint_follows_the_rows_only(spark):
    df = rows(spark)
    same = fingerprint(df, ["v"], ["series_id", "idx"])
    assert same == fingerprint(df.orderBy(F.desc("idx")).repartition(7), ["v"], ["series_id", "idx"])
    assert same != fingerprint(rows(spark, bump=0.5), ["v"], ["series_id", "idx"])
    assert same != fingerprint(df.unionByName(df.limit(1)), ["v"], ["series_id", "idx"])
    assert fingerprint(df.limit(0), ["v"], ["series_id", "idx"]).startswith("0|")


def test_state_is_reused_only_when_whole(spark, tmp_path):
    path = state_path(str(tmp_path), ["v"], "x")
    first = fit_or_load_scaler(rows(spark), ["v"], path).collect()
    assert fit_or_load_scaler(rows(spark, bump=9.0), ["v"], path).collect() == first
    os.remove(f"{path}/_SUCCESS")                                    # as a job leaves it that ended early
    again = fit_or_load_scaler(rows(spark, bump=9.0), ["v"], path).collect()
    assert again[0]["mean"] == pytest.approx(first[0]["mean"] + 9)


def test_batches_of_runs_append(spark, tmp_path):
    runs = spark.createDataFrame([("001", "r1", 1), ("002", "r2", 2)], "experiment string, run_id string, run_number long")
    mets = spark.createDataFrame([("r1", "k", 1.0, 0), ("r1", "k", 2.0, 1), ("r2", "k", 3.0, 0), ("gone", "k", 4.0, 0)],
                                 "run_id string, key string, value double, step long")
    path = str(tmp_path / "log")
    for r in ("r1", "r2"):
        log_runs(runs.where(F.col("run_id") == r), mets, path)
    got = {(x["experiment"], x["run_id"], x["value"]) for x in logged(spark, path, "metric").collect()}
    assert got == {("001", "r1", 1.0), ("001", "r1", 2.0), ("002", "r2", 3.0)}
    assert logged(spark, path, "run").count() == 2


def test_split_refuses_a_series_without_train_rows(spark):
    assert train_test_split(rows(spark, 10), 9).where("is_test").count() == 9
    for n in (10, 12):
        with pytest.raises(Exception, match="too few for"):
            train_test_split(rows(spark, 10), n).collect()


def test_array_windows_keep_nulls_in_place(spark):
    df = rows(spark, 20).withColumn("w", F.when(F.col("idx") % 3 > 0, -F.col("v")))
    for step in (1, 4):
        got = {r["window_id"]: r for r in windows.sliding_windows(df, ["v", "w"], 5, 2, step=step, chunk=4).collect()}
        assert sorted(got) == list(range(0, 14, step))
        for s, r in got.items():
            assert [x["v"] for x in r["x"]] == [1.5 * i for i in range(s, s + 5)]
            assert [y["w"] for y in r["y"]] == [-1.5 * i if i % 3 else None for i in (s + 5, s + 6)]
    assert windows.sliding_windows(df.where("idx < 6"), ["v"], 5, 2, chunk=4).count() == 0


def test_summary_without_a_list_takes_the_first_column(spark):
    out = windows.window_summary(rows(spark).withColumn("w", F.col("v")), lag=[1], replace=True)
    assert out.columns == ["series_id", "idx", "w", "v_lag_1"]
