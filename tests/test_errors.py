"""Argument errors of the operators."""

import pytest

from swellcast.operators import clean


def test_sentinel_map_must_be_dict(spark):
    df = spark.createDataFrame([(1.0,)], "WSPD double")
    with pytest.raises(ValueError):
        clean.mark_missing(df, [99.0])


def test_angles_must_be_list(spark):
    df = spark.createDataFrame([(10.0,)], "WDIR double")
    with pytest.raises(ValueError):
        clean.degrees_to_cyclic(df, "WDIR")


def test_unknown_columns_are_skipped(spark):
    df = spark.createDataFrame([(99.0, 400.0)], "WSPD double, WDIR double")
    with pytest.warns(UserWarning):
        out = clean.mark_missing(df, {"WSPD": 99.0, "NOPE": 1.0})
    assert out.first()["WSPD"] is None
    with pytest.warns(UserWarning):
        out = clean.degrees_to_cyclic(df, ["WDIR", "MWD"])
    r = out.first()
    assert r["WDIR_sin"] is None and r["WDIR_cos"] is None and "WDIR" not in out.columns


def test_angle_bounds_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (360.0,), (-1.0,), (361.0,)], "WDIR double")
    rows = clean.degrees_to_cyclic(df, ["WDIR"]).collect()
    assert [r["WDIR_cos"] is not None for r in rows] == [True, True, False, False]


def test_day_slice_rejects_bad_day(spark):
    from swellcast.plans.q_clean import day_slice
    df = spark.createDataFrame([], "series_id string, ts timestamp_ntz, v double")
    with pytest.raises(ValueError):
        day_slice(df, 2024, 2, [30], ["v"])


def test_seasonality_of_a_user_period(spark):
    import numpy as np
    import pandas as pd
    from swellcast.operators.diagnostics import acf, seasonality
    y = np.sin(np.arange(240) * 2 * np.pi / 12) + 0.01 * np.arange(240) % 3
    long = spark.createDataFrame(pd.DataFrame({"series_id": "s", "col": "y", "idx": range(240), "value": y}))
    a = acf(long, 30)
    member, other = (seasonality(a, p).first() for p in (12, 17))
    assert member["seasonal"] and member["seasonal_period"] == 12
    assert not other["seasonal"] and other["seasonal_period"] == 17
    with pytest.raises(Exception, match="period 40"):
        seasonality(a, 40).collect()
    with pytest.raises(ValueError):
        seasonality(a, 1)


def test_a_missing_prediction_is_an_error(spark):
    from swellcast.operators.metrics import score
    rows = [("s", "y", 1.0, 2.0), ("s", "y", None, 1.0)]
    schema = "series_id string, col string, y double, yhat double"
    r = score(spark.createDataFrame(rows, schema), ["series_id"], ["mape"], counts=True).first()
    assert (r["value"], r["n_scored"], r["n_null_truth"]) == (1.0, 1, 1)
    with pytest.raises(Exception, match="no prediction"):
        score(spark.createDataFrame([*rows, ("s", "y", 3.0, None)], schema), ["series_id"], ["mape"]).collect()


def test_white_test_needs_equal_steps(spark):
    from swellcast.operators.diagnostics import white_test
    rows = [("s", "y", i, float(i % 5)) for i in range(20) if i != 7]
    with pytest.raises(Exception, match="equally spaced"):
        white_test(spark.createDataFrame(rows, "series_id string, col string, idx long, value double")).collect()
