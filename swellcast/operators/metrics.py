"""Percentage-error scorers (A2-A4) and their roll-ups over blocks (A6, A7),
folds (A5, A8, A9) and trials (A10).

A scorer is a per-column aggregate over ``pe = (y - yhat) / max(|y|, eps)``;
multi-column scores are the plain mean over columns (uniform average).
Pairs with a NULL truth are left out and counted (``n_null_truth`` beside
``n_scored``); a NULL prediction where there is a truth is an error, so no
model gains by skipping hard rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPS
from ..functions.exprs import pct_error

KEY = "series_id"

@dataclass(frozen=True)
class Scorer:
    """A score of one column: ``aggregate(y, yhat, pe)`` gives an aggregate
    Column over the scored pairs - of built-in functions, or of a grouped-aggregate
    pandas UDF, which is then marked ``pandas`` as Spark runs it apart. ``post``
    is applied to the aggregate."""

    name: str
    aggregate: Callable[[Column, Column, Column], Column]
    post: Callable[[Column], Column] | None = None
    pandas: bool = False


SCORERS: dict[str, Scorer] = {
    "mspe": Scorer("MeanSquaredPercentageError", lambda y, yhat, pe: F.avg(pe * pe)),
    "rmspe": Scorer("MeanSquaredPercentageError", lambda y, yhat, pe: F.avg(pe * pe), F.sqrt),
    "mape": Scorer("MeanAbsolutePercentageError", lambda y, yhat, pe: F.avg(F.abs(pe))),
}


def register_scorer(key: str, scorer: Scorer) -> None:
    """Make a scorer known by ``key``; a known key is not replaced silently."""
    if SCORERS.get(key, scorer) != scorer:
        raise ValueError(f"scorer {key!r} exists already")
    SCORERS[key] = scorer


def _scorer(s: str | Scorer) -> Scorer:
    if isinstance(s, Scorer):
        return s
    if s not in SCORERS:
        raise ValueError(f"unknown scorer {s!r}; known: {sorted(SCORERS)}")
    return SCORERS[s]


def score(pairs: DataFrame, groups: list[str], scorers: list[str | Scorer], y: str = "y",
          yhat: str = "yhat", eps: float = EPS, per_column: bool = False, counts: bool = False) -> DataFrame:
    """Scores per ``groups`` (+ ``col`` when ``per_column``) in long form
    ``(*groups, [col,] metric, value)``. ``scorers`` are registered keys or
    :class:`Scorer` objects. The column mean is taken after the per-column root
    (A3). ``counts`` adds ``n_scored`` and ``n_null_truth``."""
    own = [_scorer(s) for s in scorers]
    missing = F.col(y).isNotNull() & F.col(yhat).isNull()
    pe = F.when(missing, F.raise_error(F.lit("a truth has no prediction"))).otherwise(pct_error(y, yhat, eps))
    p = pairs.withColumn("_pe", F.when(F.col(y).isNotNull(), pe))
    p = p.withColumn("_yhat", F.when(F.col(y).isNotNull(), F.col(yhat)))
    by = [*groups, "col"]

    def aggs(pandas: bool) -> list[Column]:
        raw = [(i, s, s.aggregate(F.col(y), F.col("_yhat"), F.col("_pe"))) for i, s in enumerate(own) if s.pandas == pandas]
        return [(s.post(e) if s.post and not pandas else e).alias(f"_s{i}") for i, s, e in raw]

    n = [F.count("_pe").alias("n_scored"), (F.count(F.lit(1)) - F.count("_pe")).alias("n_null_truth")]
    per_col = p.groupBy(*by).agg(*aggs(False), *n)
    if any(s.pandas for s in own):
        apart = p.where(F.col(y).isNotNull()).groupBy(*by).agg(*aggs(True))
        apart = apart.select(*[F.col(c).alias(f"_k_{c}") for c in by],
                             *[(s.post(F.col(f"_s{i}")) if s.post else F.col(f"_s{i}")).alias(f"_s{i}") for i, s in enumerate(own) if s.pandas])
        same = reduce(lambda a, b: a & b, [per_col[c].eqNullSafe(apart[f"_k_{c}"]) for c in by])
        per_col = per_col.join(apart, same, "left").drop(*[f"_k_{c}" for c in by])
    if per_column:
        base, keys = per_col, by
    else:
        base = per_col.groupBy(*groups).agg(*[F.avg(f"_s{i}").alias(f"_s{i}") for i in range(len(own))],
                                            F.sum("n_scored").alias("n_scored"), F.sum("n_null_truth").alias("n_null_truth"))
        keys = list(groups)
    stack = ", ".join(f"'{s.name}', _s{i}" for i, s in enumerate(own))
    out = base.select(*keys, F.expr(f"stack({len(own)}, {stack}) as (metric, value)"), "n_scored", "n_null_truth")
    return out if counts else out.drop("n_scored", "n_null_truth")


def block_scores(pairs: DataFrame, scorers: list[str | Scorer], key: str = KEY) -> DataFrame:
    """Score per ``(series, block_id)``; metric names ``block_{i}_{Name}``."""
    s = score(pairs, [key, "block_id"], scorers)
    return s.select(key, "block_id", F.col("metric").alias("scorer"),
                    F.format_string("block_%d_%s", F.col("block_id"), F.col("metric")).alias("metric"),
                    "value")


def aggregate_blocks(bscores: DataFrame, key: str = KEY) -> DataFrame:
    """``avg_{Name}`` and ``std_{Name}`` (population std) over blocks."""
    g = bscores.groupBy(key, "scorer").agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_s"))
    return g.select(key, F.expr("stack(2, concat('avg_', scorer), _a, concat('std_', scorer), _s) as (metric, value)"))


def fold_scores(pairs: DataFrame, scorers: list[str | Scorer], key: str = KEY) -> DataFrame:
    """A5 step 1: per fold, scorer and target column ``(series, fold_id, col, metric, value)``."""
    return score(pairs, [key, "fold_id"], scorers, per_column=True)


def cv_summary(fscores: DataFrame, key: str = KEY) -> DataFrame:
    """A5 step 2: mean over folds of the per-fold scores (not a mean of rows)."""
    return fscores.groupBy(key, "metric", "col").agg(F.avg("value").alias("mean_value"),
                                                     F.count("*").alias("n_folds"))


def best_fold(fscores: DataFrame, metric: str, key: str = KEY) -> DataFrame:
    """Arg-min fold of a (column-averaged) metric; ties go to the first
    fold. An unknown metric gives fold 0 with a NULL score."""
    per_fold = fscores.where(F.col("metric") == metric) \
        .groupBy(key, "fold_id").agg(F.avg("value").alias("score"))
    best = per_fold.groupBy(key).agg(
        F.min_by(F.struct("fold_id", "score"), F.struct("score", "fold_id")).alias("_b"))
    keys = fscores.select(key).distinct()
    out = keys.join(best, key, "left")
    return out.select(key, F.coalesce(F.col("_b.fold_id"), F.lit(0).cast("long")).alias("best_fold"),
                      F.col("_b.score").alias("best_score"))
