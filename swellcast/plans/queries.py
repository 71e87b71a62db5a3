"""Query registry: ``name -> callable(spark, sf_dir) -> DataFrame`` plus the
matching DuckDB oracle SQL. Names are lower-case survey ID + a short word.

Every query reads the driver's tables through the views in
:mod:`swellcast.plans.views` and runs over whole tables. Doubles are rounded
to 6 decimals at this boundary only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query (and its oracle SQL when SQL can express it)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_clean, q_diag, q_forecast, q_misc, q_runs, q_windows  # noqa: F401
