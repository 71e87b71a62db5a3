"""Exact quartiles by rank refinement."""

import numpy as np
import pytest

from swellcast.operators.profile import describe


@pytest.mark.parametrize("small", [50_000, 40, 1])
def test_quartiles_equal_pandas(spark, small):
    rng = np.random.default_rng(2)
    n = 1001
    cols = {"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": np.exp(rng.normal(size=n) * 8), "d": np.full(n, 3.5), "e": rng.normal(size=n) * 1e-300}
    rows = [tuple(None if (i + k) % 11 == 0 else float(v[i]) for k, v in enumerate(cols.values())) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "empty"]))
    want = df.toPandas().astype(float).describe()
    got = {r.column_name: r for r in describe(df, [*cols, "empty"], small=small).collect()}
    for c in cols:
        for name, key in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert got[c][name] == pytest.approx(want[c][key], rel=1e-12, abs=0 if name.startswith("p") else 1e-9), (c, name)
    assert got["empty"]["count"] == 0 and got["empty"].p50 is None and got["empty"]["max"] is None


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([(2.0,)], "v double")
    r = describe(df, ["v"]).first()
    assert (r.p25, r.p50, r.p75, r.std) == (2.0, 2.0, 2.0, None)
    assert describe(df.where("v > 9"), ["v"]).first().p50 is None
