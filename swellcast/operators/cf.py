"""Christiano-Fitzgerald band-pass cycle (D12) and the three-feature matrix.

With periods ``low``..``high``, a = 2 pi / high and b = 2 pi / low, the ideal
weights are ``B_0 = (b - a) / pi`` and ``B_j = (sin(j b) - sin(j a)) / (pi j)``.
For a series x_0..x_{n-1}, drift removed, the cycle at i is the weighted sum of
all inner values plus end values weighted so that all weights sum to zero:

    y_i = sum_{0 < t < n-1} B_|t-i| x_t + E_{n-2-i} x_{n-1} + E_{i-1} x_0  (+ B_0 x_i at an end)
    E_k = -B_0 / 2 - (B_1 + ... + B_k)

The sum is a full-length convolution (the weights fall only like 1/j), so no
halo suffices. A series is cut into chunks, and the chunks into a dyadic tree of
nodes. A chunk and its two neighbours meet by FFT. Farther nodes enter through
moments: with c a node's centre and R its half width,

    e^{iw(i-t)} / (i - t) = e^{iw(i-c)} sum_k [e^{-iw(t-c)} ((t-c)/R)^k] (R/(i-c))^k / (i-c)

so the values of a node shrink to TERMS numbers for each of w = a, b. A chunk
meets a node of its own level's width that is not beside it, but whose parent is
beside (or is) its own parent: at most three a level, and always ``|i-c| >= 3 R``,
which leaves an error of 3^-TERMS. So a series of m chunks gives O(m log m) short
rows, and 3 m rows with values. The end weights come from sums of B over the few k
a chunk needs, whose far part is summed in closed form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CF_HIGH, CF_LOW, CHUNK
from ..session import saved
from .filters import hp_filter

KEYS = ["series_id", "col"]
TERMS = 32  # moments of a node: 3^-32 of its values is below double precision


def weights(n: int, low: float, high: float) -> np.ndarray:
    """B_0..B_{n-1}."""
    j = np.arange(1, n)
    a, b = 2 * np.pi / high, 2 * np.pi / low
    return np.concatenate([[(b - a) / np.pi], (np.sin(b * j) - np.sin(a * j)) / (np.pi * j)])


def partial_cycle(x: np.ndarray, start: int, out_start: int, out_len: int, low: float, high: float) -> np.ndarray:
    """sum over t in the chunk ``x`` at ``start`` of B_|t-i| x_t, for the
    ``out_len`` rows i from ``out_start``."""
    lag = np.arange(out_start - start - len(x) + 1, out_start - start + out_len)  # i - t
    b = weights(int(np.abs(lag).max()) + 1, low, high)[np.abs(lag)]
    size = 1 << int(len(lag) + len(x)).bit_length()
    return np.fft.irfft(np.fft.rfft(b, size) * np.fft.rfft(x, size), size)[len(x) - 1:len(x) - 1 + out_len]


def tail_sum(k: int, w: float, terms: int = 16) -> complex:
    """sum over j > k of e^{iwj} / j by repeated summation by parts, for k far
    above ``terms`` periods."""
    z = np.exp(1j * w)
    r, total, d = z / (1 - z), 0.0, 1.0 / (k + 1)
    for m in range(terms):
        total += r ** m * d
        d *= -(m + 1) / (k + 2 + m)
    return z ** (k + 1) / (1 - z) * total


def end_weights(first: int, last: int, low: float, high: float) -> np.ndarray:
    """E_first..E_last (E of a negative k is E_0). Sums are direct up to a bound that
    depends on the periods only; from there on the part before ``first`` comes from
    the tail of the series, whose whole sum is known in closed form."""
    a, b = 2 * np.pi / high, 2 * np.pi / low
    near = max(4096, int(np.ceil(64 * high)))
    start = max(first, 0)
    if start <= near:
        before = weights(start + 1, low, high)[1:].sum()
    else:  # sum over all j of sin(wj) / j is (pi - w) / 2
        before = ((a - b) / 2 - (tail_sum(start, b) - tail_sum(start, a)).imag) / np.pi
    j = np.arange(start + 1, max(last, start) + 1)
    run = before + np.concatenate([[0.0], np.cumsum((np.sin(b * j) - np.sin(a * j)) / (np.pi * j))])
    return -(b - a) / (2 * np.pi) - run[np.maximum(np.arange(first, last + 1), start) - start]


def node_moments(x: np.ndarray, start: int, centre: float, half: float, low: float, high: float) -> np.ndarray:
    """Moments about a node: real and imaginary parts for both frequencies."""
    u = np.arange(start, start + len(x)) - centre
    powers = (u / half)[None, :] ** np.arange(TERMS)[:, None]
    m = np.stack([powers @ (x * np.exp(-2j * np.pi / p * u)) for p in (low, high)])
    return np.concatenate([m.real.ravel(), m.imag.ravel()])


def far_sum(mom: np.ndarray, i: np.ndarray, centre: float, half: float, low: float, high: float) -> np.ndarray:
    """sum over the node's rows t of B_|i-t| x_t for far rows ``i``."""
    re, im = mom.reshape(2, 2, TERMS)
    d = i - centre
    q, out = half / d, np.zeros(len(i))
    for sign, p, m in ((1, low, re[0] + 1j * im[0]), (-1, high, re[1] + 1j * im[1])):
        total = np.polynomial.polynomial.polyval(q, m)
        out += sign * (np.exp(2j * np.pi / p * d) * total).imag
    return out / (np.pi * d)


def cf_cycle(long: DataFrame, low: float = CF_LOW, high: float = CF_HIGH, drift: bool = True, idx: str = "idx",
             chunk: int = CHUNK) -> DataFrame:
    """D12 on ``(series_id, col, idx, value)`` (gap-free from 0, no NULLs):
    ``(series_id, col, idx, value, cycle)``. Fewer than two rows have cycle 0."""
    if not 2 <= low < high:
        raise ValueError("periods must satisfy 2 <= low < high")
    ends = long.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min_by("value", idx).alias("first"), F.max_by("value", idx).alias("last"))
    slope = F.when(F.lit(drift) & (F.col("n") > 1), (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    flat = long.join(ends, KEYS).select(*KEYS, F.col(idx).alias("i"), "value", (F.col("value") - F.col(idx) * slope).alias("x"), "n",
                                        F.col("first").alias("x0"), (F.col("last") - (F.col("n") - 1) * slope).alias("x1"),
                                        F.floor(F.col(idx) / F.lit(chunk)).alias("c"))
    blocks = saved(flat.groupBy(*KEYS, "n", "x0", "x1", "c").agg(F.array_sort(F.collect_list(F.struct("i", "x", "value"))).alias("rows")), "chunks")
    chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("long")
    inner = F.transform("rows", lambda s: F.when((s["i"] == 0) | (s["i"] == F.col("n") - 1), 0.0).otherwise(s["x"]))  # the ends have weights of their own

    def moments(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for s, col, c, m, x in zip(pdf["series_id"], pdf["col"], pdf["c"], pdf["m"], pdf["x"]):
                x, level, out = np.array(x, float), 0, []
                while m - 1 >> level >= 2:  # a level of two nodes has no far ones
                    width = chunk << level
                    node = c >> level
                    out.append((s, col, level, node, node_moments(x, c * chunk, (node + 0.5) * width - 0.5, width / 2, low, high)))
                    level += 1
                yield pd.DataFrame(out, columns=[*KEYS, "level", "node", "mom"])

    of_chunks = blocks.where(chunks > 2).select(*KEYS, "c", chunks.alias("m"), inner.alias("x")) \
        .mapInPandas(moments, "series_id string, col string, level int, node long, mom array<double>")
    nodes = of_chunks.groupBy(*KEYS, "level", "node").agg(F.array(*[F.sum(F.col("mom")[k]) for k in range(4 * TERMS)]).alias("mom"))

    # what a chunk meets: nodes of every level not beside its own, under parents beside its own parent
    levels = F.expr(f"filter(sequence(0, 62), l -> shiftright(ceil(n / {chunk}) - 1, l) >= 2)")
    meets = F.flatten(F.transform(levels, lambda lv: F.transform(
        F.filter(F.sequence(F.lit(-3), F.lit(3)), lambda o: (F.abs(o) >= 2) & (F.abs(_up(F.col("c"), lv + 1) - _up(_up(F.col("c"), lv) + o, 1)) <= 1)),
        lambda o: F.struct(lv.alias("level"), (_up(F.col("c"), lv) + o).alias("node")))))
    met = blocks.select(*KEYS, "c", F.explode(meets).alias("_w")).select(*KEYS, "c", "_w.level", "_w.node") \
        .join(nodes, [*KEYS, "level", "node"])
    far = met.groupBy(*KEYS, "c").agg(F.collect_list(F.struct("level", "node", "mom")).alias("far"))
    beside = blocks.select(*KEYS, F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), F.col("c").alias("c2"), inner.alias("x")) \
        .groupBy(*KEYS, "c").agg(F.array_sort(F.collect_list(F.struct("c2", "x"))).alias("near"))

    def finish(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples():
                i = np.array([s["i"] for s in r.rows])
                x = np.array([s["x"] for s in r.rows])
                y = np.zeros(len(i))
                for s in r.near:
                    y += partial_cycle(np.array(s["x"], float), s["c2"] * chunk, r.c * chunk, len(i), low, high)
                for s in sorted(r.far if r.far is not None else [], key=lambda s: (s["level"], s["node"])):
                    width = chunk << s["level"]
                    y += far_sum(np.array(s["mom"]), i, (s["node"] + 0.5) * width - 0.5, width / 2, low, high)
                y += end_weights(r.n - 2 - i[-1], r.n - 2 - i[0], low, high)[::-1] * r.x1 + end_weights(i[0] - 1, i[-1] - 1, low, high) * r.x0
                y += np.where((i == 0) | (i == r.n - 1), 2 * (1 / low - 1 / high) * x, 0.0)
                yield pd.DataFrame({"series_id": r.series_id, "col": r.col, idx: i, "value": [s["value"] for s in r.rows], "cycle": y if r.n > 1 else 0.0 * y})

    return blocks.drop("x").join(beside, [*KEYS, "c"]).join(far, [*KEYS, "c"], "left") \
        .mapInPandas(finish, f"series_id string, col string, {idx} long, value double, cycle double")


def _up(node: Column, levels: Column | int) -> Column:
    """Ancestor of a node, ``levels`` further up."""
    return F.floor(node / F.pow(F.lit(2.0), F.lit(levels) if isinstance(levels, int) else levels)).cast("long")


def feature_matrix(long: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """D13 on normalised series: ``(series_id, col, idx, value, hp_trend, cf_cycle)``."""
    hp = hp_filter(long, chunk=chunk).select(*KEYS, "idx", "value", F.col("trend").alias("hp_trend"))
    return hp.join(cf_cycle(long, chunk=chunk).select(*KEYS, "idx", F.col("cycle").alias("cf_cycle")), [*KEYS, "idx"])
