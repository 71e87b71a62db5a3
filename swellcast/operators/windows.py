"""Window operators on the gap-free grid.

Two scale patterns keep one long series from landing in a single task:

* **chunk + halo** for bounded frames (lags, trailing means/stds, rolling,
  sliding windows): ``chunk = idx div C``; a row is also copied into the
  neighbouring chunk(s) whose frame reaches it; the window runs over
  ``(series, chunk)``; halo copies are dropped afterwards.
* **chunk + carry** for unbounded frames (forward / backward fill, running
  sums): the in-chunk result, a per-chunk summary, a small window over the
  summaries, and a join back on ``(series, chunk)``.

With ``C`` at least the series length both reduce to the plain window; tests
run small ``C`` to prove the results are identical.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHUNK

KEY, IDX = "series_id", "idx"


# ---------------------------------------------------------------- chunk + halo
def with_halo(df: DataFrame, back: int, ahead: int = 0, idx: str = IDX,
              chunk: int = CHUNK) -> DataFrame:
    """Assign ``_own`` chunk and explode each row into every chunk whose
    frame (``back`` rows behind, ``ahead`` rows in front) reaches it."""
    i = F.col(idx)
    own = F.floor(i / F.lit(chunk))
    lo = F.greatest(F.floor((i - F.lit(ahead)) / F.lit(chunk)), F.lit(0).cast("long"))
    hi = F.floor((i + F.lit(back)) / F.lit(chunk))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(lo, hi)))


def bounded(df: DataFrame, build: Callable[[Window], dict[str, Column]], back: int,
            ahead: int = 0, key: str = KEY, idx: str = IDX, chunk: int = CHUNK) -> DataFrame:
    """Evaluate window expressions whose frame spans at most ``back`` rows
    behind and ``ahead`` rows in front, chunk-parallel."""
    x = with_halo(df, back, ahead, idx, chunk)
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    x = x.withColumns(build(w))
    return x.where(F.col("_chunk") == F.col("_own")).drop("_chunk", "_own")


# ----------------------------------------------------------------- features
def lag_name(c: str, k: int) -> str:
    return f"{c}_lag_{k}"


def mean_name(c: str, lag: int, length: int) -> str:
    return f"{c}_mean_{lag}_{length}"


def std_name(c: str, lag: int, length: int) -> str:
    return f"{c}_std_{lag}_{length}"


def _gated(agg: Callable[[Column], Column], c: str, frame: Window, length: int) -> Column:
    """Window aggregate that is NULL until the frame holds ``length`` values."""
    return F.when(F.count(F.col(c)).over(frame) == length, agg(F.col(c)).over(frame))


def lags(df: DataFrame, cols: list[str], ks: list[int], **kw) -> DataFrame:
    """``c_lag_k = c`` k rows back (k hours on the gap-free grid)."""
    return bounded(df, lambda w: {lag_name(c, k): F.lag(c, k).over(w) for c in cols for k in ks},
                   back=max(ks), **kw)


def window_summary(df: DataFrame, cols: list[str] | None = None, lag: list[int] | None = None,
                   mean: list[tuple[int, int]] | None = None,
                   std: list[tuple[int, int]] | None = None,
                   truncate_bfill: bool = True, replace: bool = False, **kw) -> DataFrame:
    """Lag / lagged-window mean / lagged-window std features.

    ``[lag, length]`` is the ``length`` rows ending ``lag`` rows back; NULL
    until the frame is full; std uses n-1. With ``truncate_bfill`` the
    leading NULLs of every feature take its first valid value (W4).
    ``replace`` drops the source columns (W5 routing: listed columns are
    replaced by their features, the others pass through). Without a list only
    the first column that is not the series, its index or a time is summarized.
    """
    if cols is None:
        held = {kw.get("key", KEY), kw.get("idx", IDX)}
        cols = [f.name for f in df.schema.fields if f.name not in held and not f.dataType.typeName().startswith(("timestamp", "date"))][:1]
    lag, mean, std = lag or [], mean or [], std or []
    back = max([0] + list(lag) + [a + b - 1 for a, b in list(mean) + list(std)])

    def build(w: Window) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in cols:
            for k in lag:
                out[lag_name(c, k)] = F.lag(c, k).over(w)
            for a, b in mean:
                out[mean_name(c, a, b)] = _gated(F.avg, c, w.rowsBetween(-(a + b - 1), -a), b)
            for a, b in std:
                out[std_name(c, a, b)] = _gated(F.stddev_samp, c, w.rowsBetween(-(a + b - 1), -a), b)
        return out

    feats = [lag_name(c, k) for c in cols for k in lag] + \
        [mean_name(c, a, b) for c in cols for a, b in mean] + \
        [std_name(c, a, b) for c in cols for a, b in std]
    out = bounded(df, build, back=back, **kw)
    if truncate_bfill:
        out = fill_leading(out, feats, key=kw.get("key", KEY), idx=kw.get("idx", IDX))
    if replace:
        out = out.drop(*cols)
    return out


def fill_leading(df: DataFrame, cols: list[str], key: str = KEY, idx: str = IDX) -> DataFrame:
    """Leading NULLs of each column take that column's first valid value.

    The first valid ``(idx, value)`` per series is a map-side-combined
    aggregate (one row per series), joined back; AQE broadcasts it when its
    measured size is under the broadcast threshold.
    """
    if not cols:
        return df
    # one min over (idx, value) structs per column gives the first valid
    # position and its value together
    aggs = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(c).alias("v"))))
            .alias(f"_f_{c}") for c in cols]
    first = df.groupBy(key).agg(*aggs)
    out = df.join(first, key, "left")
    out = out.withColumns({
        c: F.when(F.col(c).isNull() & (F.col(idx) < F.col(f"_f_{c}.i")), F.col(f"_f_{c}.v"))
        .otherwise(F.col(c)) for c in cols})
    return out.drop(*[f"_f_{c}" for c in cols])


# --------------------------------------------------------------- chunk + carry
def _carry_fill(df: DataFrame, cols: list[str], forward: bool, key: str, idx: str,
                chunk: int, leading: bool = False) -> DataFrame:
    """Fill from the nearest valid value before (``forward``) or after.

    In-chunk window + one per-chunk summary (boundary value, and for
    ``leading`` the first valid value of the chunk) + a window over the
    summaries + one join back: the input is read by exactly two branches.
    """
    x = df.withColumn("_chunk", F.floor(F.col(idx) / F.lit(chunk)))
    w = Window.partitionBy(key, "_chunk").orderBy(idx)
    if forward:
        frame = w.rowsBetween(Window.unboundedPreceding, 0)
        inner = {f"_in_{c}": F.last(c, ignorenulls=True).over(frame) for c in cols}
    else:
        frame = w.rowsBetween(0, Window.unboundedFollowing)
        inner = {f"_in_{c}": F.first(c, ignorenulls=True).over(frame) for c in cols}
    x = x.withColumns(inner)
    # per-chunk boundary value: last valid (forward) / first valid (backward)
    pick = F.max_by if forward else F.min_by
    aggs = [pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_b_{c}") for c in cols]
    if leading:
        aggs += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_f_{c}") for c in cols]
    summ = x.groupBy(key, "_chunk").agg(*aggs)
    wc = Window.partitionBy(key).orderBy("_chunk")
    if forward:
        carry_frame = wc.rowsBetween(Window.unboundedPreceding, -1)
        carry = {f"_cy_{c}": F.last(f"_b_{c}", ignorenulls=True).over(carry_frame) for c in cols}
    else:
        carry_frame = wc.rowsBetween(1, Window.unboundedFollowing)
        carry = {f"_cy_{c}": F.first(f"_b_{c}", ignorenulls=True).over(carry_frame) for c in cols}
    if leading:
        everything = wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carry.update({f"_ld_{c}": F.first(f"_f_{c}", ignorenulls=True).over(everything) for c in cols})
    summ = summ.select(key, "_chunk", *[v.alias(k) for k, v in carry.items()])
    x = x.join(summ, [key, "_chunk"], "left")
    rep = {}
    for c in cols:
        parts = [F.col(f"_in_{c}"), F.col(f"_cy_{c}")] + ([F.col(f"_ld_{c}")] if leading else [])
        rep[c] = F.coalesce(*parts)
    x = x.withColumns(rep)
    return x.drop("_chunk", *[f"_in_{c}" for c in cols], *[f"_cy_{c}" for c in cols],
                  *([f"_ld_{c}" for c in cols] if leading else []))


def ffill(df: DataFrame, cols: list[str], bfill_leading: bool = True, key: str = KEY,
          idx: str = IDX, chunk: int = CHUNK) -> DataFrame:
    """Forward fill; then (default) leading NULLs take the first valid value."""
    return _carry_fill(df, cols, True, key, idx, chunk, leading=bfill_leading)


def bfill(df: DataFrame, cols: list[str], key: str = KEY, idx: str = IDX,
          chunk: int = CHUNK) -> DataFrame:
    """Backward fill (trailing NULLs stay NULL)."""
    return _carry_fill(df, cols, False, key, idx, chunk)


def running_sum(df: DataFrame, outs: dict[str, str], keys: list[str], idx: str = IDX,
                chunk: int = CHUNK) -> DataFrame:
    """Cumulative sums (column -> output name) ordered by ``idx`` within
    ``keys`` (chunk + carry), all columns in one pass and one join.

    ``keys`` may include a derived partition (e.g. a phase) whose rows are
    spaced out in ``idx``; chunks are taken on ``idx`` all the same.
    """
    x = df.withColumn("_chunk", F.floor(F.col(idx) / F.lit(chunk)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    value = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in outs}
    tot = x.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(f"_t_{c}") for c, v in value.items()])
    x = x.withColumns({f"_in_{c}": F.sum(v).over(w) for c, v in value.items()})
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{c}").over(wc), F.lit(0.0)).alias(f"_cy_{c}") for c in outs])
    x = x.join(tot, [*keys, "_chunk"], "left")
    return x.withColumns({out: F.col(f"_in_{c}") + F.col(f"_cy_{c}") for c, out in outs.items()}) \
        .drop("_chunk", *[f"_in_{c}" for c in outs], *[f"_cy_{c}" for c in outs])


# ------------------------------------------------------------ differencing
def seasonal_diff(df: DataFrame, cols: list[str], lag: int = 24, fill_zero: bool = True,
                  suffix: str = "", **kw) -> DataFrame:
    """W9 (``fill_zero``: the first ``lag`` rows are 0) and W11 (no fill:
    the first ``lag`` rows are NULL; drop them with a filter)."""
    idx = kw.get("idx", IDX)

    def build(w: Window) -> dict[str, Column]:
        res = {}
        for c in cols:
            d = F.col(c) - F.lag(c, lag).over(w)
            res[c + suffix] = F.when(F.col(idx) < lag, F.lit(0.0) if fill_zero else F.lit(None)) \
                .otherwise(d)
        return res
    return bounded(df, build, back=lag, **kw)


def inverse_seasonal_diff(diffs: DataFrame, seeds: DataFrame, cols: list[str], lag: int = 24,
                          start_col: str = "_start", key: str = KEY, idx: str = IDX,
                          chunk: int = CHUNK) -> DataFrame:
    """Rebuild levels from seasonal differences.

    ``diffs``: ``(key, idx, *cols)`` differences for ``idx >= start`` where
    ``start`` is per series (column ``start_col`` on ``seeds``).
    ``seeds``: ``(key, idx, *cols)`` the last ``lag`` known levels, i.e. rows
    ``start-lag .. start-1``. ``level(t) = seed(phase) + running sum of d``
    over the same phase ``pmod(idx, lag)``.
    """
    seed_long = seeds.select(key, F.pmod(F.col(idx), F.lit(lag)).alias("_ph"),
                             *[F.col(c).alias(f"_seed_{c}") for c in cols])
    x = diffs.withColumn("_ph", F.pmod(F.col(idx), F.lit(lag)))
    x = running_sum(x, {c: f"_cs_{c}" for c in cols}, [key, "_ph"], idx, chunk)
    x = x.join(seed_long, [key, "_ph"], "left")
    x = x.withColumns({c: F.col(f"_seed_{c}") + F.col(f"_cs_{c}") for c in cols})
    return x.drop("_ph", *[f"_cs_{c}" for c in cols], *[f"_seed_{c}" for c in cols])


# -------------------------------------------------------------- rolling, sliding
def rolling(df: DataFrame, cols: list[str], window: int = 12, **kw) -> DataFrame:
    """``rolling(window).mean()/.std()`` (n-1), NULL until full."""
    def build(w: Window) -> dict[str, Column]:
        f = w.rowsBetween(-(window - 1), 0)
        res = {}
        for c in cols:
            res[f"{c}_roll_mean"] = _gated(F.avg, c, f, window)
            res[f"{c}_roll_std"] = _gated(F.stddev_samp, c, f, window)
        return res
    return bounded(df, build, back=window - 1, **kw)


def sliding_windows(df: DataFrame, cols: list[str], win: int, horizon: int, step: int = 1,
                    key: str = KEY, idx: str = IDX, chunk: int = CHUNK) -> DataFrame:
    """Training pairs as arrays, one row per window: ``x`` holds ``win`` and
    ``y`` the next ``horizon`` rows, each an array of structs of ``cols`` (so NULLs
    keep their place). Window ``window_id`` starts at ``idx = window_id``; only
    windows fully inside the series are kept (``N = T - win - horizon + 1``, every
    ``step``-th of them). Range frames over chunk + halo: nothing is exploded."""
    span = win + horizon
    row = F.struct(*cols)
    x = bounded(df.select(key, idx, *cols), lambda w: {
        "_x": F.collect_list(row).over(w.rowsBetween(-(span - 1), -horizon)),
        "_y": F.collect_list(row).over(w.rowsBetween(-(horizon - 1), 0))}, back=span - 1, key=key, idx=idx, chunk=chunk)
    start = F.col(idx) - (span - 1)
    return x.where((start >= 0) & (start % step == 0)).select(key, start.alias("window_id"), F.col("_x").alias("x"), F.col("_y").alias("y"))


def sliding_pairs(df: DataFrame, cols: list[str], win: int, horizon: int,
                  key: str = KEY, idx: str = IDX, chunk: int = CHUNK) -> DataFrame:
    """W13 in exploded form: one row per ``(window_id, part, step)``, ``part='x'``
    steps 0..win-1 and ``part='y'`` steps 0..horizon-1 of :func:`sliding_windows`."""
    w = sliding_windows(df, cols, win, horizon, key=key, idx=idx, chunk=chunk)
    rows = w.select(key, "window_id", F.posexplode(F.concat("x", "y")).alias("_off", "_row"))
    return rows.select(
        key, "window_id",
        F.when(F.col("_off") < win, F.lit("x")).otherwise(F.lit("y")).alias("part"),
        F.when(F.col("_off") < win, F.col("_off")).otherwise(F.col("_off") - win).alias("step"),
        *[F.col("_row")[c].alias(c) for c in cols])


def direct_lags(df: DataFrame, cols: list[str], lags_: list[int], horizon: int, **kw) -> DataFrame:
    """Features for a direct model of the last step of a ``horizon``
    chunk: lag ``k`` counted back from the chunk start = ``horizon - 1 + k``
    rows back."""
    return bounded(df, lambda w: {f"{c}_dlag_{k}": F.lag(c, horizon - 1 + k).over(w)
                                  for c in cols for k in lags_},
                   back=horizon - 1 + max(lags_), **kw)
