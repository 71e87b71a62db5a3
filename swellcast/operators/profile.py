"""Table profiles: shape / schema (S4), describe (S5), column classes (P1,
P2), null assertions (P14), constant test (A12).

Each profile is ONE aggregate pass over the table (all columns together,
map-side combined), then unpivoted to one row per column; exact quartiles take
a few more passes over the columns alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import UNIQUE_THRESHOLD
from ..session import saved


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def split_columns(df: DataFrame, output_col: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric / categorical column names (schema only, no job)."""
    fields = [f for f in df.schema.fields if f.name != output_col]
    num = [f.name for f in fields if _is_numeric(f.dataType)]
    cat = [f.name for f in fields if not _is_numeric(f.dataType)]
    return num, cat


def _stack_rows(n: int, items: list[str]) -> str:
    return f"stack({n}, {', '.join(items)})"


def profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, position, n_rows, non_null)`` per column."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(f"`{c}`")).alias(f"_nn{i}")
                                              for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    items = [f"'{c}', '{df.schema[c].dataType.simpleString()}', {i}L, _nn{i}"
             for i, c in enumerate(df.columns)]
    return one.select(F.col("_n").alias("n_rows"),
                      F.expr(_stack_rows(len(items), items) + " as (column_name, dtype, position, non_null)"))


def column_classes(df: DataFrame, output_col: str | None = None,
                   unique_threshold: int = UNIQUE_THRESHOLD, approx: bool = False) -> DataFrame:
    """P1 + P2: ``(column, kind, n_distinct, cls)``; kind numeric/categorical,
    numeric columns with fewer than ``unique_threshold`` distinct non-null
    values are 'discrete', the others 'continuous'. ``approx`` switches to
    HyperLogLog counts (sound away from the threshold)."""
    num, cat = split_columns(df, output_col)
    cnt = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    one = df.agg(*[cnt(F.col(f"`{c}`")).alias(f"_d{i}") for i, c in enumerate(num)])
    items = [f"'{c}', _d{i}" for i, c in enumerate(num)]
    out = one.select(F.expr(_stack_rows(len(items), items) + " as (column_name, n_distinct)"))
    out = out.select("column_name", F.lit("numeric").alias("kind"), F.col("n_distinct").cast("long"),
                     F.when(F.col("n_distinct") < unique_threshold, "discrete")
                     .otherwise("continuous").alias("cls"))
    if cat:
        cats = df.sparkSession.createDataFrame([(c,) for c in cat], "column_name string") \
            .select("column_name", F.lit("categorical").alias("kind"),
                    F.lit(None).cast("long").alias("n_distinct"), F.lit(None).cast("string").alias("cls"))
        out = out.unionByName(cats)
    return out


BINS = 1024          # value ranges that one pass counts in a bracket
SMALL_BRACKET = 50_000  # values that are put in order once a bracket holds no more


def order_statistics(long: DataFrame, wanted: dict[str, list[int]], limits: dict[str, tuple[int, float, float]],
                     small: int = SMALL_BRACKET) -> dict[tuple[str, int], float]:
    """The ``k``-th smallest value (from 0) of columns of ``long(col, value)``.

    Every rank has a bracket of values that holds it. A pass counts the bracket's
    values in ``BINS`` ranges and goes on with the one that the rank falls into;
    when a bracket holds few values they are counted by value and put in order.
    Only counts, bounds and results reach the driver, ``BINS`` rows a bracket at
    most. ``limits`` gives count, minimum and maximum of each column."""
    found: dict[tuple[str, int], float] = {}
    todo = {(c, k): (limits[c][1], limits[c][2], 0, limits[c][0]) for c, ks in wanted.items() for k in ks}  # lo, hi, below, inside
    while todo:
        for key, (lo, hi, _, _) in list(todo.items()):
            if lo == hi:
                found[key] = lo
                del todo[key]
        brackets = sorted({(c, *b) for (c, _), b in todo.items()})
        if not brackets:
            break
        table = long.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(brackets)], "b int, b_col string, lo double, hi double, below long, inside long")
        rows = long.join(F.broadcast(table), (F.col("col") == F.col("b_col")) & F.col("value").between(F.col("lo"), F.col("hi")))  # at most six a column
        large = rows.where(F.col("inside") > small)
        width = (F.col("hi") / BINS - F.col("lo") / BINS)
        bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(BINS - 1))
        got: dict[int, list] = {}
        if any(b[4] > small for b in brackets):
            for r in large.groupBy("b", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
                got.setdefault(r["b"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
        ranks = [(brackets.index((c, *b)), k) for (c, k), b in todo.items() if b[3] <= small]
        if ranks:
            want = long.sparkSession.createDataFrame(ranks, "w_b int, k long")
            per = rows.where(F.col("inside") <= small).groupBy("b", "value", "below").agg(F.count(F.lit(1)).alias("n"))
            upto = F.col("below") + F.sum("n").over(Window.partitionBy("b").orderBy("value"))
            hit = per.withColumn("upto", upto).join(F.broadcast(want), F.col("b") == F.col("w_b")).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
            for r in hit.select("b", "k", "value").collect():
                found[brackets[r["b"]][0], r["k"]] = r["value"]
                del todo[brackets[r["b"]][0], r["k"]]
        for (c, k), b in list(todo.items()):
            below = b[2]
            for _, n, lo, hi in sorted(got[brackets.index((c, *b))]):
                if k < below + n:
                    todo[c, k] = (lo, hi, below, n)
                    break
                below += n
    return found


def quantiles(df: DataFrame, cols: list[str], probs: list[float], limits: dict[str, tuple[int, float, float]],
              small: int = SMALL_BRACKET) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between order statistics, as
    pandas has them; None for a column without values."""
    at = {c: [p * (limits[c][0] - 1) for p in probs] for c in cols if limits[c][0]}
    wanted = {c: sorted({k for x in xs for k in (math.floor(x), math.ceil(x))}) for c, xs in at.items()}
    if not wanted:
        return {c: [None] * len(probs) for c in cols}
    long = df.select(F.expr(_stack_rows(len(cols), [f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols]) + " as (col, value)")).where(F.col("value").isNotNull())
    got = order_statistics(long, wanted, limits, small)

    def value(c: str, x: float) -> float:
        lo, hi = got[c, math.floor(x)], got[c, math.ceil(x)]
        return lo + (hi - lo) * (x - math.floor(x))

    return {c: [value(c, x) for x in at[c]] if c in at else [None] * len(probs) for c in cols}


def describe(df: DataFrame, cols: list[str], approx: bool = False, accuracy: int = 10000, small: int = SMALL_BRACKET) -> DataFrame:
    """``count, mean, std (n-1), min, 25%, 50%, 75%, max`` per column.

    Exact quartiles come from counts in ever narrower value ranges
    (:func:`order_statistics`): no task or driver ever holds a column's values.
    ``approx=True`` uses one pass with the ``percentile_approx`` sketch instead."""
    schema = "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.count(x).alias(f"_c{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).cast("double").alias(f"_lo{i}"), F.max(x).cast("double").alias(f"_hi{i}")]
        if approx:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"_q{i}"))
    df = df.select(*cols) if approx else saved(df.select(*cols), "profile")
    one = df.agg(*aggs).first()
    if approx:
        q = {c: [None if v is None else float(v) for v in one[f"_q{i}"] or [None] * 3] for i, c in enumerate(cols)}
    else:
        q = quantiles(df, cols, [0.25, 0.5, 0.75], {c: (one[f"_c{i}"], one[f"_lo{i}"], one[f"_hi{i}"]) for i, c in enumerate(cols)}, small)
    rows = [(c, one[f"_c{i}"], one[f"_m{i}"], one[f"_s{i}"], one[f"_lo{i}"], *q[c], one[f"_hi{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, schema)


def null_counts(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """P14 helper: NULL count per column (and per series when ``key``)."""
    aggs = [F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)]
    one = df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)
    items = [f"'{c}', _z{i}" for i, c in enumerate(cols)]
    keep = [key] if key else []
    return one.select(*keep, F.expr(_stack_rows(len(items), items) + " as (column_name, n_null)"))


def assert_no_nulls(df: DataFrame, cols: list[str]) -> None:
    """Raise when any listed column holds a NULL (one aggregate job)."""
    bad = [r["column_name"] for r in null_counts(df, cols).where("n_null > 0").collect()]
    if bad:
        raise AssertionError(f"NULL values in {bad}")
