import math

import numpy as np
import pytest

from conftest import SF_SMALL
from swellcast.llm import whiten
from swellcast.llm.common import read

SCHEMA = "vec_id long, embedding array<float>, id string, vector string, x string, i string, component int, n string"


def by_hand(rows, most=16):
    """{id: deviations and whitened rows}, model by NumPy's own eigenvectors."""
    xs = {}
    for k, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            xs.setdefault(k, []).append(tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v))
    fit = sorted({x for many in xs.values() for x in many})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums)] for x in fit])
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, e[::-1], vec[:, ::-1], xs


def check(got, rows):
    n, sums, e, vec, xs = by_hand(rows)
    k = min(16, len(sums))
    assert len(got) == k * sum(map(len, xs.values())) and {r.n for r in got} == {n}
    want = sorted((i, sum((n * v - s) ** 2 for v, s in zip(x, sums))) for i, many in xs.items() for x in many for _ in range(k))
    assert sorted((r.vec_id, r.deviation) for r in got) == want
    sign = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.component)):
        c = r.component - 1
        near = [np.dot(np.array([n * v - s for v, s in zip(x, sums)], float) / n, vec[:, c]) / math.sqrt(e[c]) for x in xs[r.vec_id]]
        if len(near) == 1 and abs(near[0]) > 0.05:
            assert sign.setdefault(c, math.copysign(1, near[0] * r.whitened)) == math.copysign(1, near[0] * r.whitened)
        assert min(abs(abs(r.whitened) - abs(v)) for v in near) < 1e-7
        assert abs(r.explained - e[c] / e.sum()) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whole_table(spark):
    df = read(spark, SF_SMALL, "embeddings")
    check(whiten.whiten_table(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def table(spark, rows):
    return spark.createDataFrame([(k, v and [None if c is None else float(c) for c in v], *["x"] * 4, 5, "n") for k, v in rows], SCHEMA)


def test_awkward_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(c) for c in draw.normal(0, 2, 5) * [1, 3, 9, 2, 5]]) for i in range(60)]
    rows += [(i + 100, rows[0][1]) for i in range(500)]  # a very common vector
    rows += [(700, None), (701, [1.0, None, 0, 0, 0]), (702, [float("nan"), 0, 0, 0, 0]), (703, [0, 0, float("-inf"), 0, 0])]
    check(whiten.whiten_table(table(spark, rows).repartition(6)).collect(), rows)
    other = whiten.whiten_table(table(spark, [*rows, (704, []), (705, [1.0, 2.0])])).collect()  # vectors of other lengths
    assert {r.vec_id for r in other} == {k for k, _ in rows if k < 700}
    null = [r for r in whiten.whiten_table(table(spark, [*rows, (None, rows[3][1])])).collect() if r.vec_id is None]
    assert [r.component for r in sorted(null)] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [float("nan")])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten.whiten_table(table(spark, rows)).collect() == []


def test_no_variance(spark):
    got = whiten.whiten_table(table(spark, [(k, [0.5, 0.25, -1.0]) for k in range(4)])).collect()
    assert len(got) == 12 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 for r in got)
    got = whiten.whiten_table(table(spark, [(0, [0.0, 1.0]), (1, [2.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened) for r in got if r.component == 1) in ([(0, 1, -1.0), (1, 1, 1.0)], [(0, 1, 1.0), (1, 1, -1.0)])
    assert all(r.whitened is None for r in got if r.component == 2)


def test_entry_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        whiten.whiten_table(table(spark, [(0, [3e38]), (1, [0.0])])).collect()


def test_exact_deviation_beyond_doubles():
    gap = whiten._offsets(np.array([[2**31 + 8, 5]]), 1, [7, 2])
    assert whiten._deviation(gap).tolist() == [(2**31 + 1) ** 2 + 9]
    assert whiten._offsets(np.array([[2**40]]), 2**24, [2**63 - 1]).tolist() == [[2**64 - 2**63 + 1]]
    with pytest.raises(OverflowError):
        whiten._deviation(np.array([[2**62, 2**62]], object))


@pytest.mark.parametrize("d", [1, 2, 7, 64, 150])
def test_components_equal_a_direct_solver(d):
    a = np.random.default_rng(d).standard_normal((d, d))
    cov = a @ a.T
    e, v = whiten.components(cov)
    assert np.abs(v @ np.diag(e) @ v.T - cov).max() < 1e-13 * d * e[0]
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 * d
    assert np.abs(e - np.linalg.eigvalsh(cov)[::-1]).max() < 1e-13 * d * e[0]


@pytest.mark.parametrize("cov", [np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.diag([3.0, 1, 1, 1, 0, 0]), np.diag([1e12, 1, 1e-12]), np.diag([2.0, 1, 0])])
def test_repeated_and_zero_eigenvalues(cov):
    e, v = whiten.components(cov)
    assert np.abs(v @ np.diag(e) @ v.T - cov).max() <= 1e-14 * max(1, e[0]) and np.all(np.diff(e) <= 1e-15 * max(1, e[0]))


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((40, 40))
    a = a + a.T
    u = whiten.polar(a)
    e, v = np.linalg.eigh(a)
    assert np.abs(u - v @ np.diag(np.sign(e)) @ v.T).max() < 1e-12
