"""The band-pass cycle by far-field moments against the full sums."""

import numpy as np

from swellcast.operators.cf import cf_cycle, end_weights, far_sum, node_moments, partial_cycle, weights


def whole(y, low, high):
    """All weights of all rows at once, by one long convolution."""
    n = len(y)
    x = y - np.arange(n) * (y[-1] - y[0]) / (n - 1)
    b = weights(n + 1, low, high)
    end = -b[0] / 2 - np.concatenate([[0.0], np.cumsum(b[1:])])
    inner = x.copy()
    inner[0] = inner[-1] = 0.0
    i = np.arange(n)
    out = partial_cycle(inner, 0, 0, n, low, high) + end[np.maximum(n - 2 - i, 0)] * x[-1] + end[np.maximum(i - 1, 0)] * x[0]
    out[[0, -1]] += b[0] * x[[0, -1]]
    return out


def test_end_weights_equal_their_direct_sums():
    for low, high, n in ((6, 32, 60_000), (24, 1000, 120_000)):
        b = weights(n + 1, low, high)
        want = -b[0] / 2 - np.concatenate([[0.0], np.cumsum(b[1:])])
        for first, last in ((-1, 5), (0, 0), (4000, 4200), (n - 300, n)):
            assert np.allclose(end_weights(first, last, low, high), want[np.maximum(np.arange(first, last + 1), 0)], atol=1e-13)


def test_moments_equal_the_sum_at_the_nearest_far_row():
    x, b = np.random.default_rng(0).normal(size=128), weights(600, 6, 32)
    i = np.concatenate([np.arange(-256, -128), np.arange(256, 384)])           # two nodes off, either side
    got = far_sum(node_moments(x, 0, 63.5, 64.0, 6, 32), i, 63.5, 64.0, 6, 32)
    assert np.allclose(got, [b[np.abs(k - np.arange(128))] @ x for k in i], atol=1e-12)


def test_long_series_in_short_chunks(spark):
    rng = np.random.default_rng(4)
    series = {"walk": np.cumsum(rng.normal(size=9_001)), "noise": 50 + rng.normal(size=4_097), "short": rng.normal(size=65)}
    rows = [(s, "v", i, float(v)) for s, y in series.items() for i, v in enumerate(y)]
    got = cf_cycle(spark.createDataFrame(rows, "series_id string, col string, idx long, value double"), chunk=64).toPandas()
    for s, y in series.items():
        own = got[got["series_id"] == s].sort_values("idx")
        assert len(own) == len(y)
        assert np.allclose(own["cycle"], whole(y, 6, 32), atol=1e-9), s
