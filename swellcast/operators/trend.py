"""Mann-Kendall trend tests (D2 original, D3 pre-whitened, D4 seasonal) and
Sen's slope, computed without ever forming all pairs.

``S = sum_{i<j} sign(y_j - y_i) = 2C + E - n(n-1)/2`` where ``E`` is the number
of tied pairs and ``C`` the number of increasing pairs ``i < j, y_i < y_j``.
``C`` is split three ways over a grid of time chunks and value buckets, both
with approximate quantiles as bounds (a value equal to a bound gets a "point"
bucket of its own, so heavy ties never make a bucket large):

* pairs inside one time chunk: exact count per bounded ``(group, chunk)``;
* pairs inside one value bucket, different chunks: exact count per bounded
  ``(group, bucket)`` minus its same-chunk part (point buckets add nothing);
* all other pairs differ in both chunk and bucket, so their order is decided by
  the bucket order: running sums over the small grid of cell counts.

The input is read three times (bounds, chunks, buckets), lazily.

Sen's slope is the median of all pairwise slopes. For a slope ``theta`` the
number of slopes not above it is the number of pairs that do not increase in
``y - theta * t``, so the counter above ranks any ``theta``. Rounds of such
counts shrink a bracket around the middle ranks; when few slopes are left in
it, exactly those pairs are enumerated (they are the inversions between the
orders by ``y - lo * t`` and by ``y - hi * t``) and the order statistic is taken
from them. A bracket that many equal slopes keep from emptying ends at that slope.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import saved

KEYS = ["series_id", "col"]
MIN_SIDE = 2048  # rows that a chunk or bucket holds at least, if there are so many
PROBS = 256      # most chunks and buckets of a group; they grow as n / 256 beyond
MOST_PAIRS = 1 << 20  # slopes that are enumerated once a bracket holds no more
BLOCK = 1024     # ranks of one enumeration task
SAMPLE = 600     # rows per group from which slopes are guessed (a documented bound)


def increasing_pairs(values: np.ndarray) -> int:
    """#{i<j : v_i < v_j} for values in time order: split by the bits of the
    ranks, highest first; at each bit the pairs that it decides are counted."""
    if len(values) < 2:
        return 0
    uniq, r = np.unique(values, return_inverse=True)
    total = 0
    for b in range(max(0, (len(uniq) - 1).bit_length()) - 1, -1, -1):
        one = (r >> b) & 1
        zeros = np.cumsum(1 - one)
        group = r >> (b + 1)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = np.repeat(zeros[first] - (1 - one[first]), np.diff(np.concatenate([first, [len(r)]])))
        total += int(((zeros - before) * one).sum())
        r = r[np.argsort(r >> b, kind="stable")]
    return total


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _first(pdf: pd.DataFrame, keys: list[str], n: int = 1) -> dict:
    return {k: [pdf[k].iloc[0]] * n for k in keys}


def _bounds(name: str, acc: int = 5000) -> Column:
    probs = [k / PROBS for k in range(1, PROBS)]
    return F.percentile_approx(name, probs, acc)


def _picked(bounds: str, parts: Column) -> Column:
    """``parts - 1`` of the ``PROBS - 1`` bounds, at even distances, distinct."""
    at = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at(bounds, F.floor(i * PROBS / parts).cast("int")))
    return F.when(parts > 1, F.array_distinct(at)).otherwise(F.array().cast("array<double>"))


def _below(bounds: str, v: Column) -> Column:
    return F.when(F.size(bounds) == 0, 0).otherwise(F.size(F.filter(bounds, lambda b: b < v)))


def pair_counts(x: DataFrame, keys: list[str], idx: str = "idx", min_side: int = MIN_SIDE) -> DataFrame:
    """``(keys, n, inc, tied, tie_var)`` per group of ``x(keys, idx, value)``:
    rows, increasing pairs, tied pairs and the tie term of the variance."""
    x = x.where(F.col("value").isNotNull()).select(*keys, F.col(idx).cast("double").alias("_t"), F.col("value").cast("double").alias("value"))
    parts = F.least(F.lit(PROBS), F.ceil(F.col("_n") / F.greatest(F.lit(min_side), F.sqrt("_n")))).cast("int")
    grid = x.groupBy(*keys).agg(F.count("*").alias("_n"), _bounds("value").alias("_vq"), _bounds("_t").alias("_tq")) \
        .select(*keys, _picked("_vq", parts).alias("_vb"), _picked("_tq", parts).alias("_tb"))
    v = F.col("value")
    bucket = 2 * _below("_vb", v) + F.when(F.array_contains("_vb", v), 1).otherwise(0)
    g = x.join(grid, keys).select(*keys, "_t", "value", bucket.cast("int").alias("_b"),
                                  _below("_tb", F.col("_t")).cast("int").alias("_c"), (F.size("_vb") == 0).alias("_one"))
    schema = f"{_key_schema(x, keys)}, _b int, _c int, _n long, inc long, tied double, tie_var double"

    def ties(values: np.ndarray) -> tuple[float, float]:
        t = np.unique(values, return_counts=True)[1].astype(float)
        return float((t * (t - 1) / 2).sum()), float((t * (t - 1) * (2 * t + 5)).sum())

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable")
        b, n = np.unique(pdf["_b"].to_numpy(), return_counts=True)
        out = pd.DataFrame({**_first(pdf, keys, len(b)), "_b": b, "_c": pdf["_c"].iloc[0], "_n": n, "inc": 0, "tied": 0.0, "tie_var": 0.0})
        out.loc[0, "inc"] = increasing_pairs(pdf["value"].to_numpy())
        if pdf["_one"].iloc[0]:  # the only bucket, so no other task sees its ties
            out.loc[0, "tied"], out.loc[0, "tie_var"] = ties(pdf["value"].to_numpy())
        return out

    def bucket_rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable")
        inc = increasing_pairs(pdf["value"].to_numpy()) - sum(increasing_pairs(p["value"].to_numpy()) for _, p in pdf.groupby("_c", sort=False))
        tied, tie_var = ties(pdf["value"].to_numpy())
        return pd.DataFrame({**_first(pdf, keys), "_b": -1, "_c": -1, "_n": 0, "inc": inc, "tied": tied, "tie_var": tie_var})

    cells = g.groupBy(*keys, "_c").applyInPandas(chunk, schema)
    rest = g.where("NOT _one AND _b % 2 = 0").groupBy(*keys, "_b").applyInPandas(bucket_rest, schema)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf[pdf["_b"] >= 0]
        b, c, n = (cell[k].to_numpy() for k in ("_b", "_c", "_n"))
        grid = np.zeros((b.max() + 1, c.max() + 1), np.int64)
        np.add.at(grid, (b, c), n)
        lower = np.zeros_like(grid)
        lower[1:, 1:] = grid.cumsum(axis=0).cumsum(axis=1)[:-1, :-1]
        point = grid.sum(axis=1)[1::2].astype(float)  # each holds one value
        return pd.DataFrame({**_first(pdf, keys), "n": int(n.sum()), "inc": int(pdf["inc"].sum() + (grid * lower).sum()),
                             "tied": float(pdf["tied"].sum() + (point * (point - 1) / 2).sum()),
                             "tie_var": float(pdf["tie_var"].sum() + (point * (point - 1) * (2 * point + 5)).sum())}, index=[0])

    return cells.unionByName(rest).groupBy(*keys).applyInPandas(total, f"{_key_schema(x, keys)}, n long, inc long, tied double, tie_var double")


def mk_score(long: DataFrame, keys: list[str] | None = None, idx: str = "idx", min_side: int = MIN_SIDE) -> DataFrame:
    """``(keys, n, s, var_s)`` per group of ``long(keys..., idx, value)``;
    NULL values are skipped (as missing values are)."""
    keys = keys or KEYS
    c = pair_counts(long.select(*keys, idx, "value"), keys, idx, min_side)
    n = F.col("n").cast("double")
    s = 2 * F.col("inc") + F.col("tied") - n * (n - 1) / 2
    return c.select(*keys, "n", s.cast("long").alias("s"), ((n * (n - 1) * (2 * n + 5) - F.col("tie_var")) / 18.0).alias("var_s"))


def z_score(s, var_s):
    return F.when(s > 0, (s - 1) / F.sqrt(var_s)).when(s < 0, (s + 1) / F.sqrt(var_s)).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """p = 2 * (1 - Phi(|z|)) on one value per series (small helper)."""
    return z.abs().apply(lambda v: math.erfc(v / math.sqrt(2.0)) if pd.notna(v) else float("nan"))


def _tested(score: DataFrame, alpha: float) -> DataFrame:
    x = score.withColumn("z", z_score(F.col("s"), F.col("var_s")))
    return x.withColumn("p_value", two_sided_p("z")).withColumn("trend", F.col("p_value") < alpha)


def mann_kendall(long: DataFrame, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """D2 result per series: ``n, s, var_s, z, p_value, trend``."""
    return _tested(mk_score(long, keys), alpha)


def prewhiten(long: DataFrame, r1: DataFrame, keys: list[str] | None = None, idx: str = "idx",
              tie_decimals: int = 12) -> DataFrame:
    """D3 input: ``y'_t = y_t - r1 * y_{t-1}`` for t >= 1 (equi-join on idx-1).

    ``y'`` is rounded to ``tie_decimals``: values built from a small set of
    inputs (e.g. sines of whole degrees) produce near-ties whose equality
    would otherwise depend on the last bit of ``r1``, i.e. on summation order."""
    keys = keys or KEYS
    prev = long.select(*keys, (F.col(idx) + 1).alias(idx), F.col("value").alias("_prev"))
    x = long.join(prev, [*keys, idx], "inner").join(r1, keys, "inner")
    return x.select(*keys, idx, F.round(F.col("value") - F.col("_prev") * F.col("r1"), tie_decimals).alias("value"))


def first_autocorrelation(long: DataFrame, keys: list[str] | None = None, idx: str = "idx") -> DataFrame:
    """``(keys, r1)``: lag-1 autocorrelation (0 for a constant series), by one
    equi-join with the row before."""
    keys = keys or KEYS
    d = long.join(long.groupBy(*keys).agg(F.avg("value").alias("_m")), keys).select(*keys, idx, (F.col("value") - F.col("_m")).alias("_d"))
    prev = d.select(*keys, (F.col(idx) + 1).alias(idx), F.col("_d").alias("_p"))
    c = d.join(prev, [*keys, idx], "left").groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_c0"), F.sum(F.col("_d") * F.col("_p")).alias("_c1"))
    return c.select(*keys, F.coalesce(F.col("_c1") / F.nullif(F.col("_c0"), F.lit(0.0)), F.lit(0.0)).alias("r1"))


def seasonal_long(long: DataFrame, period: int, keys: list[str] | None = None, idx: str = "idx") -> DataFrame:
    """D4 input: phase ``idx mod p`` becomes a key, ``idx div p`` the order."""
    keys = keys or KEYS
    return long.select(*keys, F.pmod(F.col(idx), F.lit(period)).cast("string").alias("phase"),
                       F.floor(F.col(idx) / F.lit(period)).alias(idx), "value")


def _over_phases(per: DataFrame, keys: list[str]) -> DataFrame:
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("var_s").alias("var_s"))


def seasonal_mann_kendall(long: DataFrame, period: int, alpha: float = 0.05,
                          keys: list[str] | None = None) -> DataFrame:
    """S and its variance summed over phases; z and p as for D2."""
    keys = keys or KEYS
    return _tested(_over_phases(mk_score(seasonal_long(long, period, keys), [*keys, "phase"]), keys), alpha)


# ------------------------------------------------------------------ Sen's slope

def _ranked(df: DataFrame, keys: list[str], z: str, out: str, min_side: int) -> DataFrame:
    """Place of each row of a group by ``(z, t descending)``, from 0: rank inside
    a value bucket plus the sizes of the buckets below."""
    parts = F.least(F.lit(PROBS), F.ceil(F.col("_n") / F.lit(min_side))).cast("int")
    grid = df.groupBy(*keys).agg(F.count("*").alias("_n"), _bounds(z).alias("_q")).select(*keys, _picked("_q", parts).alias("_qb"))
    x = df.join(grid, keys).withColumn("_k", _below("_qb", F.col(z)).cast("int")).drop("_qb")
    sizes = x.groupBy(*keys, "_k").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(F.col(z), F.col("t").desc()))
    return x.withColumn("_in", inside).join(sizes, [*keys, "_k"]).withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_k", "_in", "_before")


def _guesses(open_: DataFrame, x: DataFrame, sizes: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """Slopes to rank next, per group: even steps through the bracket, and
    where a sample of the group's slopes puts the wanted rank."""
    share = F.pmod(F.xxhash64(*keys, *part, "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = x.join(sizes.join(open_, keys, "left_semi").select(*keys, "_rows"), keys).where(share < SAMPLE / F.col("_rows")).select(*keys, *part, "t", "value")

    def fn(state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        slopes = [np.zeros(0)]
        for _, p in rows.groupby(part) if part else [(0, rows)]:
            t, y = p["t"].to_numpy(float), p["value"].to_numpy(float)
            i, j = np.triu_indices(len(t), 1)
            slopes.append((y[j] - y[i]) / (t[j] - t[i]))
        slopes, out = np.sort(np.concatenate(slopes)), []
        for r in state.itertuples():
            own = slopes[np.searchsorted(slopes, r.lo, "right"):np.searchsorted(slopes, r.hi, "left")]
            theta = list(np.linspace(r.lo, r.hi, 10)[1:-1])
            if len(own) >= 8:
                at, wide = (r.k - 0.5 - r.c_lo) / (r.c_hi - r.c_lo), 2 / math.sqrt(min(len(own), SAMPLE))
                theta += list(np.quantile(own, np.clip([at - wide, at - wide / 4, at + wide / 4, at + wide], 0, 1)))
                v = own[min(len(own) - 1, int(at * len(own)))]
                eps = max(1e-12 * abs(v), r.tiny)
                theta += [v - eps, v + eps]
            out += [c for c in theta if r.lo < c < r.hi]
        out = np.unique(out)
        return state[keys].iloc[[0] * len(out)].assign(theta=out)

    schema = f"{_key_schema(x, keys)}, theta double"
    return open_.groupBy(*keys).cogroup(some.groupBy(*keys)).applyInPandas(fn, schema)


def _enumerated(todo: DataFrame, x: DataFrame, keys: list[str], part: list[str], min_side: int) -> DataFrame:
    """The wanted order statistics of the slopes inside each bracket, from
    exactly the pairs that change their order between its ends. A pair of rows
    whose places in the two orders are intervals of ranks is judged in the block
    of ranks where the intervals begin to overlap; a block never holds more
    than its own rows and about twice the root of the bracket's pairs."""
    own = [*keys, "lo", "hi"]
    group = [*own, *part]
    rows = x.join(todo.select(*own).distinct(), keys).withColumn("_zl", F.col("off") - F.col("lo") * F.col("t")) \
        .withColumn("_zh", F.col("off") - F.col("hi") * F.col("t"))
    rows = _ranked(_ranked(rows, group, "_zl", "_rl", min_side), group, "_zh", "_rh", min_side)
    first, last = F.least("_rl", "_rh"), F.greatest("_rl", "_rh")
    rows = rows.select(*group, "t", "value", "_rl", "_rh", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))).alias("_block"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rl", kind="stable")
        t, y, rl, rh = (pdf[c].to_numpy() for c in ("t", "value", "_rl", "_rh"))
        start, b, out = np.minimum(rl, rh), int(pdf["_block"].iloc[0]), [np.zeros(0)]
        for at in range(0, len(t), 256):
            i = slice(at, min(at + 256, len(t)))
            swap = (rl[i, None] < rl[None, :]) & (rh[i, None] > rh[None, :]) & (np.maximum(start[i, None], start[None, :]) // BLOCK == b)
            p, q = np.nonzero(swap)
            p += at
            out.append((y[q] - y[p]) / (t[q] - t[p]))
        return pd.DataFrame({**_first(pdf, own), "slopes": [np.sort(np.concatenate(out)).tobytes()]})

    packed = rows.groupBy(*group, "_block").applyInPandas(block, f"{_key_schema(x, keys)}, lo double, hi double, slopes binary")

    def pick(wanted: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        s = np.concatenate([np.frombuffer(b) for b in packs["slopes"]])
        got = []
        for r in wanted.itertuples():
            at = min(max(int(r.k - r.c_lo) - 1, 0), len(s) - 1)
            got.append(float(np.partition(s, at)[at]))
        return pd.DataFrame({**_first(wanted, keys, len(got)), "v": got})

    return todo.groupBy(*own).cogroup(packed.groupBy(*own)).applyInPandas(pick, f"{_key_schema(x, keys)}, v double")


def sen_slope(long: DataFrame, keys: list[str] | None = None, idx: str = "idx", part: list[str] | None = None,
              most_pairs: int = MOST_PAIRS, min_side: int = MIN_SIDE) -> DataFrame:
    """``(keys, slope)``: median of the slopes ``(y_j - y_i) / (t_j - t_i)`` of
    all pairs of a group - with ``part``, of all pairs that agree in ``part``
    (the seasonal form: pairs of one phase). Groups without a pair get NULL.

    The number of rounds follows from the data: each cuts the bracket to a
    ninth at least, and usually to where the sample expects the median."""
    keys, part = keys or KEYS, part or []
    x = saved(long.where(F.col("value").isNotNull()).select(*keys, *part, F.col(idx).cast("double").alias("t"), F.col("value").cast("double").alias("value")), "trend")
    sizes = x.groupBy(*keys, *part).agg(F.count("*").alias("_n"), (F.max("value") - F.min("value")).alias("_rng"), F.min("value").alias("_least"), (F.max("t") - F.min("t")).alias("_span")) \
        .groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.sum(F.col("_n") * (F.col("_n") - 1) / 2).alias("_pairs"),
                            F.max("_rng").alias("_rng"), F.max("_span").alias("_span"), F.min("_least").alias("_least"))
    sizes = saved(sizes, "trend-sizes")
    x = x.join(sizes.select(*keys, "_least"), keys).withColumn("off", F.col("value") - F.col("_least")).drop("_least")  # orders lose no digits to a level
    pairs = F.col("_pairs")
    middle = F.when(pairs % 2 == 1, F.array((pairs + 1) / 2)).otherwise(F.array(pairs / 2, pairs / 2 + 1))
    state = saved(sizes.where(pairs > 0).select(
        *keys, F.explode(middle).alias("k"), (-F.col("_rng") - 1).alias("lo"), (F.col("_rng") + 1).alias("hi"),
        F.lit(0.0).alias("c_lo"), pairs.cast("double").alias("c_hi"), (F.lit(1e-12) * F.when(F.col("_rng") > 0, F.col("_rng")).otherwise(1.0) / F.greatest("_span", F.lit(1.0))).alias("tiny"),
        F.lit(None).cast("double").alias("v")), "trend-state")
    while True:
        open_ = state.where(F.col("v").isNull() & (F.col("c_hi") - F.col("c_lo") > most_pairs))
        if open_.isEmpty():
            break
        thetas = saved(_guesses(open_, x, sizes, keys, part), "trend-theta")
        z = x.join(thetas, keys).select(*keys, *part, "theta", "t", (F.col("off") - F.col("theta") * F.col("t")).alias("value"))
        counts = pair_counts(z, [*keys, *part, "theta"], "t", min_side)
        n = F.col("n").cast("double")
        le = counts.groupBy(*keys, "theta").agg(F.sum(n * (n - 1) / 2 - F.col("inc")).alias("le"))
        cols = state.columns
        one = [*keys, "k", "lo", "hi", "c_lo", "c_hi", "tiny"]
        below, above = F.col("le") < F.col("k"), F.col("le") >= F.col("k")
        got = open_.join(le, keys).where((F.col("theta") > F.col("lo")) & (F.col("theta") < F.col("hi"))).groupBy(*one).agg(
            F.max(F.when(below, F.struct("theta", "le"))).alias("_l"), F.min(F.when(above, F.struct("theta", "le"))).alias("_h"))
        got = got.select(*keys, "k", F.coalesce("_l.theta", "lo").alias("lo"), F.coalesce("_h.theta", "hi").alias("hi"),
                         F.coalesce("_l.le", "c_lo").alias("c_lo"), F.coalesce("_h.le", "c_hi").alias("c_hi"), "tiny")
        narrow = F.col("hi") - F.col("lo") <= F.greatest(4e-12 * F.greatest(F.abs("lo"), F.abs("hi")), 4 * F.col("tiny"))
        got = got.withColumn("v", F.when(narrow & (F.col("lo") < 0) & (F.col("hi") >= 0), 0.0).when(narrow, (F.col("lo") + F.col("hi")) / 2))
        kept = state.where(F.col("v").isNotNull() | (F.col("c_hi") - F.col("c_lo") <= most_pairs))
        state = saved(kept.select(*cols).unionByName(got.select(*cols)), "trend-state")
    todo = state.where(F.col("v").isNull()).select(*keys, "k", "lo", "hi", "c_lo")
    found = state.where(F.col("v").isNotNull()).select(*keys, "v").unionByName(_enumerated(todo, x, keys, part, min_side))
    slope = found.groupBy(*keys).agg(F.avg("v").alias("slope"))
    return sizes.select(*keys).join(slope, keys, "left")


# ------------------------------------------------------------------ one answer

def check_trend(long: DataFrame, alpha: float = 0.05, period: int | None = None, prewhitened: bool | None = None,
                keys: list[str] | None = None, idx: str = "idx", short: int = 50) -> DataFrame:
    """One row per series: ``test, n, s, var_s, z, p_value, trend, direction,
    slope, advice``.

    Without ``period`` the test is the original one, or the pre-whitened one
    where ``prewhitened`` says so; None decides it per series (fewer than
    ``short`` rows: pre-whitened). ``advice`` says where the choice goes against
    that rule. With ``period`` it is the seasonal test, and the slope is the
    median over the pairs of equal phase, per period. The slope is that of the
    series itself, also where the test is pre-whitened. A missing value is an error."""
    keys = keys or KEYS
    rows = saved(long.select(*keys, idx, F.when(F.col("value").isNull() | F.isnan("value"), F.raise_error(F.lit("check_trend: the series has missing values")).cast("double"))
                             .otherwise(F.col("value")).alias("value")), "check-trend")
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    advice = F.lit(None).cast("string")
    if period is not None:
        per = seasonal_long(rows, period, keys, idx)
        score = _over_phases(mk_score(per, [*keys, "phase"], idx), keys).withColumn("test", F.lit("seasonal"))
        slope = sen_slope(per, keys, idx, ["phase"])
    else:
        whiten = F.lit(prewhitened) if prewhitened is not None else F.col("_n") < short
        kind = n.select(*keys, "_n", whiten.alias("_white"))
        white = rows.join(kind.where("_white").select(*keys), keys)
        white = prewhiten(white, first_autocorrelation(white, keys, idx), keys, idx)
        own = rows.join(kind.where("NOT _white").select(*keys), keys).select(*keys, idx, "value")
        score = mk_score(own.unionByName(white), keys, idx).join(kind, keys) \
            .withColumn("test", F.when(F.col("_white"), "pre-whitened").otherwise("original"))
        advice = F.when(~F.col("_white") & (F.col("_n") < short), "short series: pre-whitening is recommended") \
            .when(F.col("_white") & (F.col("_n") > short), "long series: pre-whitening is not recommended")
        slope = sen_slope(rows, keys, idx)
    x = _tested(score.withColumn("advice", advice), alpha).join(slope, keys)
    return x.select(*keys, "test", "n", "s", "var_s", "z", "p_value", "trend",
                    F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"), "slope", "advice")
