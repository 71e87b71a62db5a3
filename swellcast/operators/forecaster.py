"""One protocol for all forecasters, with exogenous columns that are known
ahead (J5, M9, M13, M16).

``fit(y, x)`` takes the train rows - ``y`` long ``(series_id, col, idx, value)``,
``x`` wide ``(series_id, idx, exogenous columns)`` - and returns :class:`Fitted`,
whose ``table`` holds one row per series and column with its ``cutoff`` (the last
fitted ``idx``). ``predict(fitted, rows, x)`` forecasts the given ``(series_id,
idx)`` rows behind the cutoff; a row's exogenous values come from ``x`` by key. A
forecaster that needs none ignores ``x``. So a new forecaster is a class with
these two methods, and the roll-ups below work for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments
from .arima import ahead, hannan_rissanen
from .clean import add_calendar
from .cv import linear
from .forecast import ensemble_fit, naive_predict
from .gram import KEYS

ROW = ["series_id", "idx"]


@dataclass
class Fitted:
    forecaster: "Forecaster"
    table: DataFrame
    models: dict[str, Any] = field(default_factory=dict)


class Forecaster(Protocol):
    exog: list[str]

    def fit(self, y: DataFrame, x: DataFrame | None = None) -> Fitted: ...

    def predict(self, fitted: Fitted, rows: DataFrame, x: DataFrame | None = None) -> DataFrame: ...


def _with_exog(rows: DataFrame, x: DataFrame | None, exog: list[str]) -> DataFrame:
    if not exog:
        return rows
    if x is None or (missing := set(exog) - set(x.columns)):
        raise ValueError(f"the forecaster needs exogenous columns {sorted(exog if x is None else missing)}")
    return rows.join(x.select(*ROW, *exog), ROW, "left")


@dataclass
class Naive:
    """M1-M3: last value or mean, per target column."""

    strategies: dict[str, str]
    exog: list[str] = field(default_factory=list)

    def fit(self, y: DataFrame, x: DataFrame | None = None) -> Fitted:
        return Fitted(self, ensemble_fit(y, self.strategies).withColumnRenamed("cutoff_idx", "cutoff"))

    def predict(self, fitted: Fitted, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
        return naive_predict(fitted.table, rows.select(*ROW, F.explode(F.array(*map(F.lit, self.strategies))).alias("col"))).select(*KEYS, "idx", "yhat")


@dataclass
class Arima:
    """M4: ARIMA(1,0,1) with constant."""

    m: int = 20
    chunk: int = segments.CHUNK
    exog: list[str] = field(default_factory=list)

    def fit(self, y: DataFrame, x: DataFrame | None = None) -> Fitted:
        return Fitted(self, hannan_rissanen(y, self.m, self.chunk).withColumnRenamed("last_idx", "cutoff"))

    def predict(self, fitted: Fitted, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
        return rows.select(*ROW).join(fitted.table, "series_id").select(*KEYS, "idx", ahead(F.col("idx") - F.col("cutoff")).alias("yhat"))


@dataclass
class Regression:
    """Least squares per series and column on a constant and exogenous columns."""

    exog: list[str]
    chunk: int = segments.CHUNK

    def fit(self, y: DataFrame, x: DataFrame | None = None) -> Fitted:
        rows = _with_exog(y, x, self.exog)
        whole = y.groupBy("series_id").agg(F.lit(0).cast("long").alias("fold_id"), F.lit(0).cast("long").alias("lo"), (F.max("idx") + 1).alias("hi"))
        beta = segments.fold_regression(rows, self.exog, whole, lambda u: F.when(u < 0, -1).otherwise(0).cast("long"), self.chunk)
        return Fitted(self, beta.join(whole.select("series_id", (F.col("hi") - 1).alias("cutoff")), "series_id").drop("fold_id"))

    def predict(self, fitted: Fitted, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
        known = _with_exog(rows.select(*ROW), x, self.exog)
        return known.join(fitted.table, "series_id").select(*KEYS, "idx", linear("beta", self.exog).alias("yhat"))


@dataclass
class Trees:
    """Boosted trees on exogenous columns (with ``ts``, on the calendar as well),
    one pooled MLlib model per target; each series enters with its train mean, so
    that one model serves series of different levels."""

    exog: list[str]
    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    seed: int = 42

    def _features(self, rows: DataFrame, x: DataFrame | None) -> tuple[DataFrame, list[str]]:
        ts = ["ts"] if x is not None and "ts" in x.columns else []
        out, names = _with_exog(rows, x, [*self.exog, *ts]), [*self.exog, "_level"]
        if ts:
            out = add_calendar(out, "ts", cyclic=True)
            out = out.withColumns({c: F.col(c).cast("double") for c in ("month", "hour")})
            names += ["month", "hour", "hr_sin", "hr_cos"]
        return VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="error").transform(out.na.drop(subset=names)), names

    def fit(self, y: DataFrame, x: DataFrame | None = None) -> Fitted:
        table = y.groupBy(*KEYS).agg(F.avg("value").alias("_level"), F.max("idx").alias("cutoff"))
        train = self._features(y.join(table, KEYS).where(F.col("value").isNotNull()), x)[0]
        models = {}
        for c in sorted(r["col"] for r in table.select("col").distinct().collect()):  # target columns, not rows
            gbt = GBTRegressor(featuresCol="_features", labelCol="value", predictionCol="yhat", maxIter=self.max_iter, maxDepth=self.max_depth,
                               stepSize=self.step_size, seed=self.seed)
            models[c] = gbt.fit(train.where(F.col("col") == c))
        return Fitted(self, table, models)

    def predict(self, fitted: Fitted, rows: DataFrame, x: DataFrame | None = None) -> DataFrame:
        at = rows.select(*ROW).join(fitted.table, "series_id")
        known = self._features(at, x)[0]
        out = None
        for c, model in fitted.models.items():
            part = model.transform(known.where(F.col("col") == c)).select(*KEYS, "idx", "yhat")
            out = part if out is None else out.unionByName(part)
        return at.select(*KEYS, "idx").join(out, [*KEYS, "idx"], "left")  # a row without its exogenous values has no forecast


def forecast_with_exog(fitted: Fitted, x_train: DataFrame, x_test: DataFrame) -> DataFrame:
    """Forecast every hour from each series' cutoff to the end of ``x_test``
    in one go, with the exogenous rows of both parts stitched together and
    reindexed (hours that neither has are NULL), and return the hours of
    ``x_test``. A row of ``x_test`` that the span does not reach is an error."""
    cutoff = fitted.table.groupBy("series_id").agg(F.max("cutoff").alias("_cut"))
    ends = x_test.groupBy("series_id").agg(F.max("idx").alias("_end"))
    span = cutoff.join(ends, "series_id").where("_end > _cut").select("series_id", F.explode(F.sequence(F.col("_cut") + 1, F.col("_end"))).alias("idx"))
    x = span.join(x_train.unionByName(x_test), ROW, "left")
    return _exactly(fitted.forecaster.predict(fitted, span, x), x_test, fitted)


def _exactly(pred: DataFrame, rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The forecasts at ``rows``, one per row and fitted column; a row without any
    is an error (J2)."""
    keys = rows.select(*ROW).join(fitted.table.select(*KEYS), "series_id", "left")
    got = pred.withColumn("_got", F.lit(True))
    found = keys.join(got, [*KEYS, "idx"], "left")
    wrong = F.raise_error(F.concat(F.lit("no forecast for idx "), F.col("idx").cast("string"))).cast("double")
    return found.select(*KEYS, "idx", F.when(F.col("_got").isNull(), wrong).otherwise(F.col("yhat")).alias("yhat"))


def predict_block(fitted: Fitted, block: DataFrame, x_test: DataFrame | None = None, use_exog: bool = False) -> DataFrame:
    """Forecast the rows of one block at their absolute times. With
    ``use_exog`` the block's rows of ``x_test`` are picked by key (J5); a block row
    that ``x_test`` lacks is an error."""
    if not use_exog or x_test is None:
        return _exactly(fitted.forecaster.predict(fitted, block.select(*ROW)), block, fitted)
    picked = block.select(*ROW).join(x_test.withColumn("_known", F.lit(True)), ROW, "left")
    lost = F.raise_error(F.concat(F.lit("no exogenous row at idx "), F.col("idx").cast("string"))).cast("long")
    picked = picked.withColumn("idx", F.when(F.col("_known").isNull(), lost).otherwise(F.col("idx"))).drop("_known")
    return _exactly(fitted.forecaster.predict(fitted, picked.select(*ROW), picked), block, fitted)
