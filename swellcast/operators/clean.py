"""Cleaning transforms: sentinels (P3), compass angles (P4), drops (P5),
the full preprocessing chain (P19) and calendar features (P10/P11)."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANGLE_COLUMNS, CHUNK, DROP_COLUMNS, SENTINELS
from .grid import hourly_mean


def mark_missing(df: DataFrame, missing_map: dict) -> DataFrame:
    """Sentinel value(s) -> NULL per column; unknown columns are skipped
    with a warning; a non-dict map is a ``ValueError``."""
    if not isinstance(missing_map, dict):
        raise ValueError(f"markers must be given as a dict from column to value(s), got {type(missing_map).__name__}")
    rep = {}
    for c, vals in missing_map.items():
        if c not in df.columns:
            warnings.warn(f"no column {c!r} to mark missing values in")
            continue
        vals = list(vals) if isinstance(vals, (list, tuple, set)) else [vals]
        rep[c] = F.when(F.col(c).isin(*[F.lit(float(v)) for v in vals]), F.lit(None)) \
            .otherwise(F.col(c))
    return df.withColumns(rep) if rep else df


def degrees_to_cyclic(df: DataFrame, columns) -> DataFrame:
    """Values outside [0, 360] -> NULL, add ``c_sin``/``c_cos`` at the end,
    drop ``c``. Missing columns are skipped; non-list argument -> ``ValueError``."""
    if not isinstance(columns, (list, tuple)):
        raise ValueError(f"angle columns must be a list or tuple, got {type(columns).__name__}")
    out = df
    for c in columns:
        if c not in out.columns:
            warnings.warn(f"no angle column {c!r}")
            continue
        good = F.when(F.col(c).between(0.0, 360.0), F.col(c))
        rad = F.radians(good)
        out = out.withColumns({f"{c}_sin": F.sin(rad), f"{c}_cos": F.cos(rad)}).drop(c)
    return out


def drop_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: drop the listed columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def preprocess(df: DataFrame, key: str = "series_id", ts: str = "ts",
               missing_map: dict | None = None, angles: list[str] | None = None,
               drops: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """P3 -> P4 -> P5 -> A1, in that order (sentinels are removed before
    the hourly mean, so they never mix into it)."""
    x = mark_missing(df, SENTINELS if missing_map is None else missing_map)
    x = degrees_to_cyclic(x, ANGLE_COLUMNS if angles is None else angles)
    x = drop_present(x, DROP_COLUMNS if drops is None else drops)
    cols = [c for c in x.columns if c not in (key, ts)]
    return hourly_mean(x, cols, key=key, ts=ts, chunk=chunk)


def add_calendar(df: DataFrame, ts: str = "ts", cyclic: bool = True) -> DataFrame:
    """P10 (``month``, ``hour``, ``hr_sin``, ``hr_cos``) / P11 (``cyclic=False``)."""
    hr = F.hour(F.col(ts))
    cols = {"month": F.month(F.col(ts)).cast("long"), "hour": hr.cast("long")}
    if cyclic:
        cols["hr_sin"] = F.sin(F.lit(2.0 * math.pi) * hr / F.lit(24.0))
        cols["hr_cos"] = F.cos(F.lit(2.0 * math.pi) * hr / F.lit(24.0))
    return df.withColumns(cols)


def slice_bounds(start: str, end: str):
    """``(lo, hi)`` TIMESTAMP_NTZ columns of the half-open range of P6."""
    lo = F.lit(_unit_start(start)).cast("timestamp_ntz")
    hi = F.lit(_unit_start(end)).cast("timestamp_ntz")
    unit = _unit_of(end)
    if unit == "instant":
        return lo, F.timestamp_add("MICROSECOND", F.lit(1), hi)
    return lo, F.timestamp_add(unit.upper(), F.lit(1), hi)


def date_slice(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """``.loc[start:end]`` with both ends inclusive; an end given as a day
    (``YYYY-MM-DD``) or month (``YYYY-MM``) covers the whole day / month.
    Written as a half-open range on ``ts`` so it pushes down to the scan."""
    lo, hi = slice_bounds(start, end)
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))


def _unit_of(s: str) -> str:
    s = s.strip()
    if len(s) == 4:
        return "year"
    if len(s) == 7:
        return "month"
    if len(s) == 10:
        return "day"
    return "instant"


def _unit_start(s: str) -> str:
    s = s.strip()
    u = _unit_of(s)
    if u == "year":
        return f"{s}-01-01 00:00:00"
    if u == "month":
        return f"{s}-01 00:00:00"
    if u == "day":
        return f"{s} 00:00:00"
    return s
