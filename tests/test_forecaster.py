"""The forecaster protocol, exogenous columns at predict time, custom scorers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swellcast.operators import forecaster as P
from swellcast.operators import metrics
from swellcast.operators.scaling import to_long

RNG = np.random.default_rng(8)
N, CUT = 200, 150


@pytest.fixture(scope="module")
def data(spark):
    rows, truth = [], {}
    for s, (a, b) in {"p": (3.0, 2.0), "q": (-1.0, 0.5)}.items():
        x = RNG.normal(size=N)
        y = a + b * x
        truth[s] = y
        rows += [(s, i, float(y[i]), float(10 + y[i] ** 2), float(x[i]), float(i % 5)) for i in range(N)]
    df = spark.createDataFrame(rows, "series_id string, idx long, u double, v double, ex double, other double")
    df = df.withColumn("ts", F.timestamp_add("HOUR", F.col("idx"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    train = df.where(F.col("idx") <= CUT)
    x = df.select("series_id", "idx", "ts", "ex", "other")
    return {"y": to_long(train, ["u", "v"], ["series_id", "idx"]), "x_train": x.where(F.col("idx") <= CUT), "x_test": x.where(F.col("idx") > 180),
            "x": x, "truth": truth, "df": df}


FORECASTERS = {"naive": P.Naive({"u": "last", "v": "mean"}), "arima": P.Arima(m=5), "regression": P.Regression(["ex"]), "trees": P.Trees(["ex", "other"], max_iter=3)}


@pytest.mark.parametrize("name", FORECASTERS)
def test_all_forecasters_run_through_the_protocol(data, name):
    fitted = FORECASTERS[name].fit(data["y"], data["x_train"])
    assert {(r.series_id, r.col, r.cutoff) for r in fitted.table.select("series_id", "col", "cutoff").collect()} == {(s, c, CUT) for s in "pq" for c in "uv"}
    full = data["x"].where(F.col("idx").between(CUT + 1, 180)).unionByName(data["x_train"])
    got = P.forecast_with_exog(fitted, full, data["x_test"]).collect()
    assert sorted((r.series_id, r.col, r.idx) for r in got) == [(s, c, i) for s in "pq" for c in "uv" for i in range(181, N)]
    assert all(r.yhat is not None for r in got)
    if name == "regression":
        assert all(abs(r.yhat - data["truth"][r.series_id][r.idx]) < 1e-9 for r in got if r.col == "u")
    block = data["df"].where(F.col("idx").between(160, 170)).select("series_id", "idx")
    one = P.predict_block(fitted, block, data["x"], use_exog=True).collect()
    assert len(one) == 2 * 2 * 11
    if not FORECASTERS[name].exog:
        assert {(r.series_id, r.col, r.idx, r.yhat) for r in P.predict_block(fitted, block).collect()} == {(r.series_id, r.col, r.idx, r.yhat) for r in one}


def test_hours_without_exogenous_rows_have_no_forecast(data):
    fitted = P.Regression(["ex"]).fit(data["y"], data["x_train"])
    hole = data["x_test"].withColumn("ex", F.when(F.col("idx") != 190, F.col("ex")))
    got = {(r.series_id, r.col, r.idx): r.yhat for r in P.forecast_with_exog(fitted, data["x_train"], hole).collect()}
    assert [k for k, v in got.items() if v is None and k[2] != 190] == [] and got["p", "u", 190] is None


def test_missing_exogenous_input_is_an_error(data):
    fitted = P.Regression(["ex"]).fit(data["y"], data["x_train"])
    block = data["df"].where(F.col("idx").between(160, 170)).select("series_id", "idx")
    with pytest.raises(ValueError, match="exogenous columns"):
        P.predict_block(fitted, block)
    with pytest.raises(ValueError, match="other"):
        P.Regression(["ex", "other"]).fit(data["y"], data["x_train"].drop("other"))
    with pytest.raises(Exception, match="no exogenous row at idx 160"):
        P.predict_block(fitted, block.where("idx = 160"), data["x_test"], use_exog=True).collect()
    early = data["x"].where(F.col("idx").between(CUT, CUT + 3))
    with pytest.raises(Exception, match=f"no forecast for idx {CUT}"):
        P.forecast_with_exog(fitted, data["x_train"], early).collect()


PAIRS = [("s", "a", 1.0, 2.0), ("s", "a", 2.0, 2.5), ("s", "a", 4.0, 3.0), ("s", "b", 1.0, 1.5), ("s", "b", None, 9.0), ("t", "a", 5.0, 5.0)]


def test_custom_scorers(spark):
    pairs = spark.createDataFrame(PAIRS, "series_id string, col string, y double, yhat double")

    @F.pandas_udf("double")
    def worst(y: pd.Series, yhat: pd.Series) -> float:
        return float((y - yhat).abs().max())

    median = metrics.Scorer("MedianAbsolutePercentageError", lambda y, yhat, pe: F.median(F.abs(pe)))
    slow = metrics.Scorer("WorstError", lambda y, yhat, pe: worst(y, yhat), F.sqrt, pandas=True)
    got = {(r.series_id, r.col, r.metric): r.value for r in metrics.score(pairs, ["series_id"], ["mape", median, slow], per_column=True).collect()}
    assert got["s", "a", "MedianAbsolutePercentageError"] == 0.25 and got["s", "a", "WorstError"] == 1.0
    assert got["s", "b", "WorstError"] == pytest.approx(0.5 ** 0.5) and got["t", "a", "MeanAbsolutePercentageError"] == 0.0
    mean = {(r.series_id, r.metric): (r.value, r.n_scored) for r in metrics.score(pairs, ["series_id"], [median], counts=True).collect()}
    assert mean["s", "MedianAbsolutePercentageError"] == ((0.25 + 0.5) / 2, 4)
    with pytest.raises(ValueError, match="unknown scorer"):
        metrics.score(pairs, ["series_id"], ["none"])
    with pytest.raises(ValueError, match="exists"):
        metrics.register_scorer("mape", median)
