"""Recursive boosted-tree forecasting (M8), pooled over all series.

Training: per target column one MLlib GBT on the target-lag summary
(lags 1,2,3,4,24,48,72 and lagged means [1,24], [24,48]) of the scaled,
seasonally differenced target plus the exogenous feature table.

Prediction walks forward one step at a time for ALL series at once. The state
is one wide row per series: for every target an array of its last ``max_back``
values, and the known future exogenous rows as an array over the horizon. A
step is a narrow projection (features from the arrays) and the fitted model's
own ``transform``; nothing is shuffled between steps, and the small state is
checkpointed reliably every few steps to keep the plan short.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KEY = "series_id"


def lag_features(lags: list[int], means: list[tuple[int, int]]) -> list[str]:
    return [f"lag_{k}" for k in lags] + [f"mean_{a}_{b}" for a, b in means]


def fit_models(train: DataFrame, targets: list[str], exog_feats: list[str], lags: list[int],
               means: list[tuple[int, int]], max_iter: int = 20, max_depth: int = 5, step_size: float = 0.1,
               subsampling_rate: float = 0.8, seed: int = 42) -> dict:
    """``train(series_id, col, label, lag_*, mean_*, *exog_feats)`` -> model per target."""
    feats = lag_features(lags, means) + exog_feats
    asm = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="error")
    models = {}
    for c in targets:
        rows = asm.transform(train.where(F.col("col") == c).na.drop(subset=[*feats, "label"]))
        models[c] = GBTRegressor(featuresCol="_features", labelCol="label", predictionCol="yhat",
                                 maxIter=max_iter, maxDepth=max_depth, stepSize=step_size,
                                 subsamplingRate=subsampling_rate, seed=seed).fit(rows)
    return {"models": models, "assembler": asm}


def predict_recursive(fitted: dict, state: DataFrame, exog_future: DataFrame, horizon: int,
                      lags: list[int], means: list[tuple[int, int]], exog_feats: list[str],
                      checkpoint_every: int = 24) -> DataFrame:
    """Walk ``horizon`` steps for every series. ``state(series_id, col, r,
    value)`` has the known values (r <= 0), ``exog_future(series_id, r,
    *exog_feats)`` the exogenous rows of r = 1..horizon. A series that lacks
    one of these rows or values is an error. Returns ``(series_id, col, r, yhat)``."""
    models = fitted["models"]
    back = max(lags + [a + b - 1 for a, b in means])
    in_order = lambda c, kind: F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[kind])
    known = state.where((F.col("r") > -back) & (F.col("r") <= 0)).groupBy(KEY).pivot("col", list(models)).agg(in_order(F.col("value").alias("v"), "v"))
    ahead = exog_future.where((F.col("r") >= 1) & (F.col("r") <= horizon)) \
        .select(KEY, "r", F.array(*[F.col(f).cast("double") for f in exog_feats]).alias("v")) \
        .groupBy(KEY).agg(in_order("v", "v").alias("_ahead"))
    x = known.join(ahead, KEY, "left")

    def whole(c, size, what):
        ok = F.size(F.col(c)) == size  # NULL array: not ok
        return F.when(F.coalesce(ok, F.lit(False)), F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{what} of series "), F.col(KEY), F.lit(f" lack some of their {size} rows"))))

    x = x.select(KEY, whole("_ahead", horizon, "future exogenous rows").alias("_ahead"),
                 *[whole(c, back, f"known values of {c}").alias(c) for c in models],
                 *[F.array().cast("array<double>").alias(f"_out_{c}") for c in models])
    x = materialize(x)
    for h in range(1, horizon + 1):
        for c, model in models.items():
            hist = F.col(c)
            feats = [F.element_at(hist, back - k + 1) for k in lags]
            feats += [F.aggregate(F.slice(hist, back - (a + b - 1) + 1, b), F.lit(0.0), lambda s, v: s + v) / F.lit(float(b)) for a, b in means]
            x = model.transform(x.withColumn("_features", array_to_vector(F.concat(F.array(*feats), F.element_at("_ahead", h)))))
            x = x.withColumns({c: F.concat(F.slice(hist, 2, back - 1), F.array("yhat")), f"_out_{c}": F.concat(F.col(f"_out_{c}"), F.array("yhat"))}) \
                .drop("_features", "yhat")
        if h % checkpoint_every == 0 or h == horizon:
            x = materialize(x)
    parts = [x.select(KEY, F.lit(c).alias("col"), F.posexplode(f"_out_{c}").alias("r", "yhat")) for c in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("r", (F.col("r") + 1).cast("long"))
