import pytest

from conftest import SF_ORACLE
from swellcast.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    from swellcast.plans.check import _norm
    got = QUERIES[name](spark, SF_ORACLE)
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    rows = lambda data: sorted((tuple(_norm(v) for v in r) for r in data), key=repr)
    assert rows(got.select(cols).collect()) == rows(rel.fetchall())
