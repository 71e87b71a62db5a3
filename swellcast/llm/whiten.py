"""Embedding whitening: principal components by QDWH spectral
divide-and-conquer, applied with a broadcast projection.

Spark does what grows with the rows: the distinct quantised vectors (the fit
list), their exact integer sums, one centred Gram of the fit list as partial
sums per task, and the projection of every row. What is left is a covariance of
``d x d`` entries, whose size the dimension bounds, not the rows. Its
eigenvectors come from polar decompositions: the polar factor of ``A - s I``
(QR-based dynamically weighted Halley iteration) has the eigenvalues +1 and -1,
so ``(U + I) / 2`` projects onto the components above ``s``; both invariant
subspaces are split further until each holds one component.

Defined results: rows whose vector is null or holds a null or non-finite entry
are left out; so are vectors whose length is not the table's most frequent one
(of equally frequent lengths, the longest); an empty table, or one of empty
vectors, gives no rows; repeated vectors count once in the fit and are all
projected; null ids stay null; a component without variance (as when all
vectors are equal) has ``whitened`` null, ``explained`` 0 and no part in ``identity_error``; other columns are never read. A
deviation beyond 64 bits is an error, never a wrapped number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET = 64, 1_000_000
EPS = float(np.finfo(np.float64).eps)
MAX_LONG = (1 << 63) - 1


# ------------------------------------------------------------------ components

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QDWH: at most eight
    QR decompositions whatever the condition, weights from a lower bound on
    the smallest singular value."""
    k = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    low, eye = EPS, np.eye(k)
    for _ in range(12):
        sq = low * low
        w = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + w)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * w + 8 * (2 - sq) / (sq * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:k] @ q[k:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        step, x = np.linalg.norm(new - x), new
        if 1 - low < 4 * EPS and step < np.cbrt(4 * EPS):
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int]:
    """Orthonormal basis whose first ``r`` columns span the components above
    some shift, the others those below it. A shift that meets an eigenvalue
    leaves coupling between both parts; the next one is tried then."""
    k = len(a)
    diag = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.mean(diag) * np.eye(k))
    draw = np.random.default_rng(k)
    best = None
    for trial in range(8):
        shift = np.mean(diag) if trial == 0 else np.median(diag) if trial == 1 else np.mean(diag) + draw.uniform(-0.5, 0.5) * spread / np.sqrt(k)
        project = (polar(a - shift * np.eye(k)) + np.eye(k)) / 2
        r = int(round(np.trace(project)))
        if not 0 < r < k:
            continue
        base = np.linalg.qr(project @ draw.standard_normal((k, r)))[0]
        base = np.linalg.qr(project @ base, mode="complete")[0]
        left = np.linalg.norm(base[:, r:].T @ a @ base[:, :r])
        if best is None or left < best[0]:
            best = (left, base, r)
        if left <= 16 * EPS * np.sqrt(k) * scale:
            break
    if best is None:
        raise ArithmeticError("no shift separates the spectrum")
    return best[1], best[2]


def components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix in falling order and their unit
    eigenvectors as columns; the largest entry of each is positive."""
    d = len(cov)
    cov = (cov + cov.T) / 2
    scale = np.linalg.norm(cov)
    parts: list[np.ndarray] = []
    todo = [(cov, np.eye(d))]
    while todo:
        a, basis = todo.pop()
        k = len(a)
        if k == 1 or np.linalg.norm(a - np.trace(a) / k * np.eye(k)) <= EPS * scale:
            parts.append(basis)
            continue
        q, r = split(a, scale)
        for cols in (q[:, r:], q[:, :r]):
            sub = cols.T @ a @ cols
            todo.append(((sub + sub.T) / 2, basis @ cols))
    v = np.hstack(parts) if parts else np.zeros((0, 0))
    v = np.linalg.qr(v)[0] if d else v  # rounding of the products of bases
    values = np.einsum("ij,ij->j", v, cov @ v)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(d)]) if d else np.ones(0)
    return values[order], v * np.where(sign == 0, 1, sign)


# ------------------------------------------------------------------------ rows

def _quantised(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts, ends and values ``x`` of the batch's usable vectors."""
    vec = batch.column("vector")
    keep = np.asarray(vec.is_valid())
    flat = vec.values.cast(pa.float64())
    c = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
    at = np.asarray(vec.offsets, np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    keep &= bad[at[1:]] == bad[at[:-1]]
    scaled = np.floor(SCALE * np.where(np.isfinite(c), c, 0))
    if scaled.size and np.abs(scaled).max() >= 1 << 62:
        raise OverflowError("an entry of a vector does not fit 64 bits")
    x = scaled.astype(np.int64) + OFFSET
    rows = np.flatnonzero(keep)
    return batch.column("id").take(pa.array(rows)), at[rows], at[rows + 1], x


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(df[id_col].alias("id"), df[vec_col].alias("vector"))


def _distinct(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The distinct usable vectors as packed 64-bit integers. Equal vectors are
    merged before the shuffle, so a very common one is no hot key."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, lo, hi, x = _quantised(b)
            yield pa.RecordBatch.from_arrays([pa.array([x[i:j].tobytes() for i, j in zip(lo, hi)], pa.binary())], ["x"])

    return _vectors(df, id_col, vec_col).mapInArrow(pack, "x binary").distinct()


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(batch.num_rows, d)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: in 64 bits where that holds every step."""
    s = np.array(sums, object)
    if n * max(map(abs, (int(x.max()), int(x.min()))), default=0) + max(map(abs, sums)) <= MAX_LONG if x.size else True:
        return n * x - s.astype(np.int64)
    return n * x.astype(object) - s


def _deviation(gap: np.ndarray) -> np.ndarray:
    """Sum of squares of each row, exact."""
    if gap.size and gap.shape[1] * int(np.abs(gap).max()) ** 2 <= MAX_LONG:
        return (gap * gap).sum(axis=1, dtype=np.int64)
    total = [sum(int(v) * int(v) for v in row) for row in gap]
    if any(t > MAX_LONG for t in total):
        raise OverflowError("a deviation does not fit 64 bits")
    return np.array(total, np.int64)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # d x d, columns
    identity_error: float

    def projection(self, most: int) -> np.ndarray:
        """``d x most`` matrix that whitens a centred vector; columns without
        variance are NaN."""
        e = self.values[:most]
        live = e > len(self.values) * EPS * max(self.values[0], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(live, self.vectors[:, :most] / np.sqrt(np.where(live, e, 1)), np.nan)


def _gram(fit: DataFrame, d: int, change, width: int) -> np.ndarray:
    """Sum of outer products of ``change(rows)`` over the fit list: one partial
    sum per task, upper triangle, added up by entry."""
    ij = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = change(_matrix(b, d))
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ij[0], pa.int32()), pa.array(ij[1], pa.int32()), pa.array(total[ij])], ["i", "j", "v"])

    got = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> Whitening | None:
    """Whitening of the distinct vectors; None where there is none. Only sums
    of ``d`` and ``d x d`` entries reach the driver."""
    every = stored(_distinct(df, id_col, vec_col), "vectors")
    sizes = every.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).limit(1).collect()
    if not sizes or not sizes[0]["bytes"]:
        return None
    d, n = sizes[0]["bytes"] // 8, sizes[0]["count"]
    own = every.where(F.octet_length("x") == 8 * d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(_matrix(b, d).sum(axis=0))], ["i", "s"])

    got = own.mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = [0] * d
    for r in got:
        sums[r["i"]] = r["s"]

    def centred(x: np.ndarray) -> np.ndarray:
        return _offsets(x, n, sums).astype(np.float64) / n

    values, vectors = components(_gram(own, d, centred, d) / n)
    model = Whitening(n, sums, values, vectors, 0.0)
    p = model.projection(most)
    live = np.flatnonzero(~np.isnan(p[0]))
    if live.size:
        p = p[:, live]
        spread = _gram(own, d, lambda x: centred(x) @ p, live.size) / n
        model.identity_error = float(np.abs(spread - np.eye(live.size)).max())
    return model


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n,
    deviation, whitened, explained, identity_error. The projection (``d`` times
    ``most`` numbers, bounded by the dimension) is broadcast."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    source = _vectors(df, id_col, vec_col)
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d, p = len(model.sums), model.projection(most)
    k = p.shape[1]
    total = float(model.values.sum())
    share = np.clip(model.values[:k] / total, 0, 1) if total > 0 else np.zeros(k)
    held = df.sparkSession.sparkContext.broadcast((model.n, model.sums, p, share, model.identity_error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, p, share, error = held.value
        for b in batches:
            ids, lo, hi, x = _quantised(b)
            rows = np.flatnonzero(hi - lo == d)
            for at in range(0, rows.size, 2048):
                own = rows[at:at + 2048]
                gap = _offsets(x[lo[own][:, None] + np.arange(d)], n, sums)
                score = (gap.astype(np.float64) / n) @ p
                m = own.size
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(_deviation(gap), k)),
                    pa.array(score.reshape(-1), mask=np.isnan(score.reshape(-1))), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def whiten_table(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """Fit on the distinct vectors of ``df`` and whiten all of its rows."""
    return whiten(df, fit(df, id_col, vec_col, most), id_col, vec_col, most)
