"""Column-expression helpers (JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPS

def epoch() -> Column:
    """1970-01-01 00:00:00 as TIMESTAMP_NTZ."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_floor(ts: str | Column) -> Column:
    """Start of the hour holding ``ts``, kept as TIMESTAMP_NTZ (``date_trunc``
    would return a zoned TIMESTAMP)."""
    return F.window(col(ts), "1 hour").start


def hour_number(ts: str | Column) -> Column:
    """Whole hours since 1970-01-01 for an hour-aligned TIMESTAMP_NTZ."""
    return F.timestamp_diff("HOUR", epoch(), col(ts))


def hour_ts(hr: str | Column) -> Column:
    """Inverse of :func:`hour_number`."""
    return F.timestamp_add("HOUR", col(hr), epoch())


def day_number(d: str | Column) -> Column:
    return F.datediff(col(d), F.lit("1970-01-01").cast("date"))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero denominator (ANSI mode is on)."""
    return num / F.nullif(den, F.lit(0.0))


def pct_error(y: str | Column, yhat: str | Column, eps: float = EPS) -> Column:
    """(y - yhat) / max(|y|, eps), the term of the percentage errors."""
    return (col(y) - col(yhat)) / F.greatest(F.abs(col(y)), F.lit(eps))


def two_pi_over(period: float) -> Column:
    return F.lit(2.0 * math.pi / period)


def round_doubles(df, digits: int = 6):
    """Round every double column (used at the comparison boundary only).

    The value goes through an exact decimal of 11 places: decimal ties, common
    in this data, then round half up however the last bit of a sum fell. NaN,
    infinities and values beyond the decimal's range stay as they are."""
    from pyspark.sql import types as T

    def rounded(c):
        fits = F.abs(c) < 1e26
        return F.when(fits, F.round(F.when(fits, c).cast("decimal(38,11)"), digits).cast("double")).otherwise(c)

    rep = {f.name: rounded(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(rep) if rep else df
