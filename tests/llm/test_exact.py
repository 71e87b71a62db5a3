import random

import pytest
from brute import sha
from pyspark.sql import functions as F

from swellcast.llm import exact


def rows(seed=1):
    rnd = random.Random(seed)
    pool = ["", None, "a", "A", "a ", "long " * 2000] + ["t%d" % rnd.randint(0, 40) for _ in range(60)]
    return [(i, rnd.choice(pool)) for i in range(300)]


def want(data):
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    return {(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t or "")) for i, t in data}


@pytest.mark.parametrize("how", ["default", "weak digest", "one batch", "many batches"])
def test_equals_grouping_by_text(spark, how):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    extra = {"weak digest": {"digest": lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)}, "one batch": {"batch": F.lit(0)},
             "many batches": {"batch": F.col("doc_id") % 5}}.get(how, {})
    got = {tuple(r) for r in exact.exact_dedup(df, **extra).collect()}
    assert got == want(data)


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "y"), (None, "z")], "doc_id long, text string")
    num = lambda x: -1 if x is None else x
    got = sorted((num(r.doc_id), num(r.keep_id), r.group_size, r.kept) for r in exact.exact_dedup(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 2, 2, False), (1, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True)]
