"""Transform steps as saved and loaded pipeline stages."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from swellcast.operators import impute, transformers as T
from swellcast.operators.scaling import to_long

RNG = np.random.default_rng(5)
N, CUT = 420, 300


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for s in ("a", "b"):
        y = np.zeros(N)
        for t in range(1, N):
            y[t] = 0.8 * y[t - 1] + RNG.normal()
        gaps = RNG.random((N, 3)) < 0.1
        gaps[:4, 0] = True
        gaps[CUT - 3:CUT + 9, 0] = True  # a gap across the end of the fitted rows
        for i in range(N):
            v = [None if gaps[i, k] else float(x) for k, x in enumerate((y[i], 3 * y[i] + 1, np.sin(i)))]
            rows.append((s, i, *v))
    df = spark.createDataFrame(rows, "series_id string, idx long, m double, p double, q double")
    return df.withColumn("ts", F.timestamp_add("HOUR", F.col("idx"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(r) for r in df.select("series_id", "idx", *[F.round(c, 9).alias(c) for c in cols if c not in ("series_id", "idx", "ts")]).collect())


def test_saved_and_loaded_set_gives_the_same_rows(table):
    train = table.where(F.col("idx") < CUT)
    pipes = T.transform_set(["m", "p"], ["q"], ["m"], chunk=90)
    for part, keep in (("x", ["series_id", "ts", "idx", "m", "p"]), ("y", ["series_id", "ts", "idx", "q"])):
        fitted = pipes[part].fit(train.select(*keep))
        path = tempfile.mkdtemp(prefix="swellcast-pipe-") + "/model"
        fitted.write().save(path)
        again = PipelineModel.load(path)
        want = rows_of(fitted.transform(table.select(*keep)))
        assert rows_of(again.transform(table.select(*keep))) == want and len(want) == 2 * N
        assert not any(v is None for r in want for v in r)
        kinds = [type(s).__name__ for s in again.stages]
        assert kinds == ["PipelineModel", "PipelineModel"] and type(again.stages[0].stages[-1]).__name__ == "SeriesScalerModel"
    unfitted = tempfile.mkdtemp(prefix="swellcast-pipe-") + "/unfitted"
    pipes["x"].write().save(unfitted)
    assert [type(s).__name__ for s in Pipeline.load(unfitted).getStages()[0].getStages()] == ["ModelImputer", "ForwardFill", "SeriesScaler"]


def test_imputer_goes_on_from_the_state_of_the_fitted_rows(table):
    train, test = table.where(F.col("idx") < CUT), table.where(F.col("idx") >= CUT)
    model = T.ModelImputer(cols=["m"], chunk=70).fit(train)
    whole = {(r.series_id, r.idx): r.m for r in model.transform(table).collect()}
    behind = {(r.series_id, r.idx): r.m for r in model.transform(test).collect()}
    assert len(behind) == 2 * (N - CUT)
    assert all(abs(whole[k] - v) < 1e-9 for k, v in behind.items())
    raw = {(r.series_id, r.idx): r.m for r in table.collect()}
    assert all(whole[k] == v for k, v in raw.items() if v is not None) and all(v is not None for v in whole.values())
    # nothing of the test rows is used: the fit is that of the train rows alone
    long = to_long(train, ["m"], ["series_id", "idx"])
    alone = {(r.series_id, r.idx): r.value for r in impute.apply_imputer(long, model.state, 1000).collect()}
    assert all(abs(whole[k] - v) < 1e-9 for k, v in alone.items())
    with pytest.raises(Exception, match="neither at the series' start"):
        model.transform(test.where(F.col("idx") > CUT + 5)).collect()


def test_scaler_inverse(table):
    filled = T.ForwardFill(cols=["q"]).transform(table)
    model = T.SeriesScaler(cols=["q"]).fit(filled.where(F.col("idx") < CUT))
    back = model.inverse(model.transform(filled))
    assert rows_of(back.select("series_id", "idx", "q")) == rows_of(filled.select("series_id", "idx", "q"))
