"""The transform steps as ``pyspark.ml`` stages, so that a fitted chain is one
``PipelineModel`` that is saved, loaded and applied as a whole (M6, M7, S6).

Stages work on wide frames ``(series_id, idx, columns...)`` of many series. A
fitted stage's state is a small table (one row per series and column); it is
saved as Parquet beside the stage's parameters and read back lazily. Estimators
see only the rows that they are fitted on; a fitted chain is applied to train
and test rows together, so that lags and fills of the first test rows reach back
into the train rows. A user's own step is a class of the same form.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK, LAGGED_MEANS, TARGET_LAGS
from ..session import saved
from . import windows
from .clean import add_calendar
from .impute import apply_imputer, fit_imputer
from .scaling import apply_scaler, fit_scaler, to_long

KEY, IDX = "series_id", "idx"


class _Columns(Params):
    """The columns that a stage works on, and the rows of a chunk."""

    cols = Param(Params._dummy(), "cols", "columns of the stage", TypeConverters.toListString)
    chunk = Param(Params._dummy(), "chunk", "rows of a chunk", TypeConverters.toInt)

    def __init__(self, **params) -> None:
        super().__init__()
        self._setDefault(chunk=CHUNK, cols=[])
        self._set(**params)

    def _of(self, name: str):
        return self.getOrDefault(name)


class _Stage(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage without state."""


class ForwardFill(_Stage):
    """Forward fill, leading gaps from the first value."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return windows.ffill(dataset, self._of("cols"), chunk=self._of("chunk"))


class Difference(_Stage):
    """Difference at ``lag`` with the first rows 0."""

    lag = Param(Params._dummy(), "lag", "rows back", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return windows.seasonal_diff(dataset, self._of("cols"), self._of("lag"), fill_zero=True, chunk=self._of("chunk"))


class Calendar(_Stage):
    """P10: month, hour and the hour's sine and cosine, from the column ``ts``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_calendar(dataset).withColumns({c: F.col(c).cast("double") for c in ("month", "hour")})


class Summary(_Stage):
    """Lags and lagged means, leading rows back-filled; ``replace`` drops
    the source columns. ``means`` lists ``lag, length`` pairs one after another."""

    lags = Param(Params._dummy(), "lags", "lags", TypeConverters.toListInt)
    means = Param(Params._dummy(), "means", "lag, length, lag, length ...", TypeConverters.toListInt)
    replace = Param(Params._dummy(), "replace", "drop the source columns", TypeConverters.toBoolean)

    def __init__(self, **params) -> None:
        super().__init__()
        self._setDefault(lags=[], means=[], replace=False)
        self._set(**params)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flat = self._of("means")
        return windows.window_summary(dataset, self._of("cols"), self._of("lags"), list(zip(flat[::2], flat[1::2])),
                                      replace=self._of("replace"), chunk=self._of("chunk"))


# ---------------------------------------------------------------- with a state

class _StateWriter(MLWriter):
    def __init__(self, instance: "_Fitted") -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.state.write.parquet(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls: type["_Fitted"]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "_Fitted":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out.state = self.sparkSession.read.parquet(f"{path}/state")
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _Fitted(_Columns, Model, MLReadable, MLWritable):
    """A fitted stage; ``state`` is its table."""

    state: DataFrame | None = None

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _Fits(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    model: type[_Fitted]

    def _state(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> _Fitted:
        out = self.model(cols=self._of("cols"), chunk=self._of("chunk"))
        out.state = saved(self._state(dataset), "state")  # a fit runs here, not in every later plan
        return out


class SeriesScalerModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_scaler(dataset, self.state, self._of("cols"))

    def inverse(self, dataset: DataFrame) -> DataFrame:
        """Back to the original scale."""
        return apply_scaler(dataset, self.state, self._of("cols"), inverse=True)


class SeriesScaler(_Fits):
    """Standard scaling per series."""

    model = SeriesScalerModel

    def _state(self, dataset: DataFrame) -> DataFrame:
        return fit_scaler(dataset, self._of("cols"))


class ModelImputerModel(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self._of("cols")
        filled = apply_imputer(to_long(dataset, cols, [KEY, IDX]), self.state, self._of("chunk"))
        wide = filled.groupBy(KEY, IDX).pivot("col", cols).agg(F.first("value"))
        out = dataset.drop(*cols).join(wide, [KEY, IDX], "left")
        return out.select(*dataset.columns)


class ModelImputer(_Fits):
    """M5 as a step: gaps filled by an ARMA model whose order, coefficients and
    state come from the fitted rows. Applied to rows right behind these, it goes
    on from that state."""

    model = ModelImputerModel

    def _state(self, dataset: DataFrame) -> DataFrame:
        cols, chunk = self._of("cols"), self._of("chunk")
        filled = windows.ffill(dataset.select(KEY, IDX, *cols), cols, chunk=chunk)
        return fit_imputer(to_long(dataset, cols, [KEY, IDX]), to_long(filled, cols, [KEY, IDX]), chunk=chunk)


# ------------------------------------------------------------------- the set

CALENDAR = ["month", "hour", "hr_sin", "hr_cos"]


def exogenous_pipeline(cols: list[str], modelled: list[str], chunk: int = CHUNK) -> Pipeline:
    """M6's X pipeline: columns in ``modelled`` are imputed by their model, the
    others forward-filled; then all are scaled."""
    rest = [c for c in cols if c not in modelled]
    stages = [ModelImputer(cols=modelled, chunk=chunk)] if modelled else []
    return Pipeline(stages=[*stages, ForwardFill(cols=rest, chunk=chunk), SeriesScaler(cols=cols, chunk=chunk)])


def target_pipeline(cols: list[str], chunk: int = CHUNK) -> Pipeline:
    """M6's Y pipeline: forward fill, then scale."""
    return Pipeline(stages=[ForwardFill(cols=cols, chunk=chunk), SeriesScaler(cols=cols, chunk=chunk)])


def feature_pipeline(cols: list[str], chunk: int = CHUNK) -> Pipeline:
    """Calendar columns, exogenous lags and lagged means in place of the columns
    themselves, all scaled."""
    names = [windows.lag_name(c, 1) for c in cols] + [windows.mean_name(c, a, b) for c in cols for a, b in LAGGED_MEANS]
    means = [k for pair in LAGGED_MEANS for k in pair]
    return Pipeline(stages=[Calendar(), Summary(cols=cols, lags=[1], means=means, replace=True, chunk=chunk),
                            SeriesScaler(cols=[*CALENDAR, *names], chunk=chunk)])


def lag_pipeline(cols: list[str], diff_lag: int = 24, chunk: int = CHUNK) -> Pipeline:
    """Lag difference and target-lag summary of scaled targets."""
    means = [k for pair in LAGGED_MEANS for k in pair]
    return Pipeline(stages=[Difference(cols=cols, lag=diff_lag, chunk=chunk), Summary(cols=cols, lags=TARGET_LAGS, means=means, chunk=chunk)])


def transform_set(exog: list[str], targets: list[str], modelled: list[str], diff_lag: int = 24, chunk: int = CHUNK) -> dict[str, Pipeline]:
    """M7: all five transforms, in the order in which they are fitted - two
    pipelines whose stages are pipelines: scale the exogenous columns, then their
    features; scale the targets, then difference and lags."""
    return {"x": Pipeline(stages=[exogenous_pipeline(exog, modelled, chunk), feature_pipeline(exog, chunk)]),
            "y": Pipeline(stages=[target_pipeline(targets, chunk), lag_pipeline(targets, diff_lag, chunk)])}
