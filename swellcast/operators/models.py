"""Boosted-tree forecasters on MLlib (M9 direct; the feature table is W15).

``pooling='global'``: one model per target for all series, trained by
MLlib's distributed tree aggregation - no per-series loop, no driver-side
data. Parameter mapping from the reference's XGBoost settings:
n_estimators -> maxIter, learning_rate -> stepSize, max_depth -> maxDepth
(MLlib refuses depths over 30), subsample -> subsamplingRate, gamma -> minInfoGain.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import add_calendar
from .windows import direct_lags


def direct_features(df: DataFrame, targets: list[str], lags: list[int], horizon: int,
                    ts: str = "ts") -> tuple[DataFrame, list[str]]:
    """W15 lags of every target + calendar columns; returns (frame, feature names)."""
    x = direct_lags(df, targets, lags, horizon)
    x = add_calendar(x, ts, cyclic=True)
    feats = [f"{c}_dlag_{k}" for c in targets for k in lags] + ["month", "hour", "hr_sin", "hr_cos"]
    return x.withColumns({"month": F.col("month").cast("double"), "hour": F.col("hour").cast("double")}), feats


def fit_predict_direct(train: DataFrame, test: DataFrame, feats: list[str], target: str,
                       max_iter: int = 20, max_depth: int = 5, step_size: float = 0.1,
                       subsampling_rate: float = 0.8, seed: int = 42) -> DataFrame:
    """Fit one GBT on the train rows with complete features (the first rows
    have no lags yet), predict every row of ``test``, where a missing feature
    is an error; returns ``test`` with ``yhat``."""
    asm = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="error")
    tr = asm.transform(train.na.drop(subset=[*feats, target]))
    gbt = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="yhat", maxIter=max_iter,
                       maxDepth=max_depth, stepSize=step_size, subsamplingRate=subsampling_rate, seed=seed)
    model = gbt.fit(tr)
    return model.transform(asm.transform(test)).drop("_features")
