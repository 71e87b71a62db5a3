from itertools import product

import numpy as np
from pyspark.sql import functions as F

from swellcast.llm import langid
from swellcast.llm.common import crc_mod


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    k, sizes = 3, [4, 0, 1, 5]
    score, step, first = (rng.normal(size=s).astype(np.float32) for s in ((sum(sizes), k), (k, k), (k,)))
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    got = langid.marginals(score, ptr, step, first)
    for a, b in zip(ptr, ptr[1:]):
        want = np.zeros((b - a, k))
        for path in product(range(k), repeat=b - a):
            if path:
                w = np.exp(first[path[0]] + sum(score[a + t, y] for t, y in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:])))
                for t, y in enumerate(path):
                    want[t, y] += w
        if b > a:
            np.testing.assert_allclose(got[a:b], want / want.sum(1, keepdims=True), rtol=1e-3)


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held)
    right = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    by = {r.lang: r.text for r in docs.where("n_chars between 800 and 2000").select("lang", "text").dropDuplicates(["lang"]).collect()}
    parts = [by["en"].split()[:40], by["de"].split()[:40], by["fr"].split()[:40]]
    _, p = langid.label_words([" ".join(sum(parts, []))], model)
    truth = np.repeat([model.labels.index(x) for x in ("en", "de", "fr")], 40)
    assert (p.argmax(1) == truth).mean() > 0.85


def test_undetermined(spark):
    model = langid.fit([("en", "the cat sat on the mat " * 5), ("de", "die katze sitzt auf der matte " * 5)])
    assert langid.predict(["", "123 !! 45", "the cat sat"], model)[:2] == [("und", 0.0)] * 2
    assert langid.predict(["the cat"], langid.train(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"), F.lit(True))) == [("und", 0.0)]
    only = langid.fit([("xx", "some words")])
    assert langid.predict(["anything"], only) == [("xx", 1.0)]
