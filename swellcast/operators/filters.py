"""Hodrick-Prescott trend / cycle (D11), chunk-parallel and exact.

The trend solves ``(I + lambda D'D) tau = y`` (D = second differences), a
symmetric positive-definite pentadiagonal system. It is partitioned: a chunk's
rows depend on the rest of the series only through the two rows on either side
of it. So every ``(series, col, chunk)`` group solves its own block for ``y`` and
for those four neighbours at once, and sends what this says of its own two outer
rows at each end; the small system of the interfaces of a series (four unknowns a
chunk) is solved by block elimination in order; then every chunk is solved once
more with its neighbours known. No row is copied to another chunk, and the result
is that of the whole system for every lambda and chunk length.

A block is solved as a block tridiagonal system (``BLOCK`` rows a step) for all
right-hand sides together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK, HP_LAMBDA

KEYS = ["series_id", "col"]


def hp_bands(n: int, lamb: float):
    """Diagonals (main, first, second) of ``I + lamb * D'D``."""
    d0, d1, d2 = np.ones(n), np.zeros(max(n - 1, 0)), np.zeros(max(n - 2, 0))
    m = max(n - 2, 0)               # second-difference row r touches r, r+1, r+2
    for a, c in enumerate((1.0, 4.0, 1.0)):
        d0[a:a + m] += lamb * c
    d1[:m] -= 2.0 * lamb
    d1[1:m + 1] -= 2.0 * lamb
    d2[:m] += lamb
    return d0, d1, d2


BLOCK = 32


def solve_penta(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive-definite pentadiagonal system for one or many
    right-hand sides, by elimination over blocks of rows."""
    n, rhs = len(d0), b.reshape(len(d0), -1).astype(float)
    size = max(2, min(BLOCK, n))
    cuts = [*range(0, n, size), n]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2:
        del cuts[-2]  # the last block couples two rows
    diag, upper, out = [], [], np.empty_like(rhs)
    for lo, hi in zip(cuts, cuts[1:]):
        m = hi - lo
        a = np.diag(d0[lo:hi]) + np.diag(d1[lo:hi - 1], 1) + np.diag(d1[lo:hi - 1], -1)
        a += np.diag(d2[lo:hi - 2], 2) + np.diag(d2[lo:hi - 2], -2) if m > 2 else 0.0
        r = rhs[lo:hi].copy()
        couple = np.zeros((m, min(2, n - hi) if hi < n else 0))  # to the first rows of the next block
        if hi < n:
            couple[-1, 0] = d1[hi - 1]
            if m > 1:
                couple[-2, 0] = d2[hi - 2]
            if couple.shape[1] > 1:
                couple[-1, 1] = d2[hi - 1]
        if diag:  # eliminate the block before: it reaches the first rows of this one
            c, z, back = upper[-1], diag[-1], before
            k = c.shape[1]
            a[:k, :k] -= back.T @ c
            r[:k] -= back.T @ z
        solved = np.linalg.solve(a, np.hstack([r, couple]))
        diag.append(solved[:, :rhs.shape[1]])
        upper.append(solved[:, rhs.shape[1]:])
        before = couple
    for i in range(len(cuts) - 2, -1, -1):
        lo, hi = cuts[i], cuts[i + 1]
        out[lo:hi] = diag[i]
        if hi < n:
            out[lo:hi] -= upper[i] @ out[hi:hi + upper[i].shape[1]]
    return out.reshape(b.shape)


def _part(first: int, m: int, n: int, lamb: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals of the rows ``first .. first + m - 1`` of a series of ``n``, and
    their coupling to the two rows before and the two after."""
    def bands(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = np.arange(lo, hi)
        r0, r1, r2 = ((g - k >= 0) & (g - k <= n - 3) & (g >= 0) for k in range(3))  # second differences that touch the row
        return 1 + lamb * (1.0 * r0 + 4.0 * r1 + 1.0 * r2), lamb * (-2.0 * r0 - 2.0 * r1), lamb * (1.0 * r0)

    d0, d1, d2 = bands(first - 2, first + m)
    side = np.zeros((m, 4))
    if first > 0:
        side[0, 0], side[0, 1] = d2[0], d1[1]
        side[1:2, 1] = d2[1]
    if first + m < n:
        side[-1, 2], side[-1, 3] = d1[-1], d2[-1] if first + m + 1 < n else 0.0
        side[-2:-1, 2] = d2[-2]
    if first == 1:
        side[0, 0] = 0.0
    return d0[2:], d1[2:-1], d2[2:-2], side


def hp_filter(long: DataFrame, lamb: float = HP_LAMBDA, chunk: int = CHUNK, idx: str = "idx") -> DataFrame:
    """D11 on ``(series_id, col, idx, value)`` (gap-free from 0, no NULLs):
    ``(series_id, col, idx, value, trend, cycle)``."""
    chunk = max(4, chunk)  # a chunk has two rows at each end
    n = long.groupBy(*KEYS).agg((F.max(idx) + 1).alias("_n"))
    last = F.greatest(F.floor(F.col("_n") / F.lit(chunk)) - 1, F.lit(0))  # the rest of a division joins the last chunk
    x = long.select(*KEYS, F.col(idx).alias("idx"), "value").join(n, KEYS) \
        .withColumn("_chunk", F.least(F.floor(F.col("idx") / F.lit(chunk)), last))

    def system(pdf: pd.DataFrame):
        pdf = pdf.sort_values("idx", kind="stable")
        ix = pdf["idx"].to_numpy()
        if np.any(np.diff(ix) != 1):
            raise ValueError("the HP filter needs a gap-free grid (fill gaps first)")
        return pdf, pdf["value"].to_numpy(dtype=float), _part(int(ix[0]), len(ix), int(pdf["_n"].iloc[0]), lamb)

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, (d0, d1, d2, side) = system(pdf)
        ends = solve_penta(d0, d1, d2, np.column_stack([y, side]))[[0, min(1, len(y) - 1), max(0, len(y) - 2), -1]]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in KEYS}, "_chunk": [int(pdf["_chunk"].iloc[0])], "ends": [ends.ravel().tolist()]})

    def interfaces(pdf: pd.DataFrame) -> pd.DataFrame:
        """Block elimination over the chunks in order: z_c + W_c [z_{c-1} ends, z_{c+1} starts] = u_c."""
        pdf = pdf.sort_values("_chunk")
        e = np.array(pdf["ends"].tolist()).reshape(-1, 4, 5)
        k = len(e)
        gain, shift = np.zeros((k, 4, 2)), np.zeros((k, 4))  # z_c = shift_c - gain_c z_{c+1}[:2]
        for c in range(k):
            a, u = np.eye(4), e[c, :, 0].copy()
            if c:
                left = e[c, :, 1:3]
                a[:, :2] -= left @ gain[c - 1][2:]
                u -= left @ shift[c - 1][2:]
            sol = np.linalg.solve(a, np.column_stack([u, e[c, :, 3:5]]))
            shift[c], gain[c] = sol[:, 0], sol[:, 1:]
        z = np.zeros((k + 1, 4))
        for c in range(k - 1, -1, -1):
            z[c] = shift[c] - gain[c] @ z[c + 1][:2]
        near = np.hstack([np.vstack([np.zeros(2), z[:k - 1, 2:]]), z[1:, :2]])
        return pdf[[*KEYS, "_chunk"]].assign(near=near.tolist())

    borders = x.groupBy(*KEYS, "_chunk").applyInPandas(outer, "series_id string, col string, _chunk long, ends array<double>") \
        .groupBy(*KEYS).applyInPandas(interfaces, "series_id string, col string, _chunk long, near array<double>")

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, (d0, d1, d2, side) = system(pdf)
        tau = solve_penta(d0, d1, d2, y - side @ np.asarray(pdf["near"].iloc[0], float))
        return pdf[[*KEYS, "idx", "value"]].assign(trend=tau, cycle=y - tau)

    out = x.join(borders, [*KEYS, "_chunk"]).groupBy(*KEYS, "_chunk").applyInPandas(
        fn, "series_id string, col string, idx long, value double, trend double, cycle double")
    return out if idx == "idx" else out.withColumnRenamed("idx", idx)
