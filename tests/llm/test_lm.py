import math
import zlib
from collections import Counter

import numpy as np
from brute import tokens
from pyspark.sql import functions as F

from swellcast.llm import lm

ROWS = [(i, " ".join(("The cat sat on mat number %d" % (i % 7)).split()[: i % 9]) + (" zz%d" % i if i % 4 == 0 else "")) for i in range(120)] + [(500, None), (501, ""), (502, "unseen words only")]


def exact_counts(rows):
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(), Counter()
    for t in train:
        w = tokens(t, True) + ["end"]
        one.update(w)
        two.update(zip(["start", *w], w))
    return one, two, len(train)


def test_base_and_model_scores(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, chunk_bytes=600, bytes_per_part=300).collect()}
    one, two, ends = exact_counts(ROWS)
    n, v = sum(one.values()), len(one)
    back = lambda c: float(lm.middle(lm.levels(np.array([c])))[0]) if c else 0.0
    off = 0
    for i, t in ROWS:
        w = tokens(t, True) + ["end"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), abs_tol=1e-9)
        score = 0.0
        for a, b in zip(["start", *w], w):
            context = back(ends if a == "start" else one[a])
            follow = min(back(two[a, b]), context) / max(context, 1)
            score += math.log10(lm.MIX * follow + (1 - lm.MIX) * (back(one[b]) + 0.5) / (n + 0.5 * (v + 1)))
        off += not math.isclose(r.score, score, abs_tol=1e-9)  # a Bloom filter's false positives
        assert r.score <= 0
    assert off <= 0.2 * len(ROWS)


def test_filter_reads_back_levels():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000).astype(np.uint64))
    counts = rng.integers(1, 50, len(keys)) ** 3
    f = lm.LogFrequencyFilter(keys, counts)
    assert (f.levels(keys) >= lm.levels(counts)).all()  # one-sided error
    assert (f.levels(keys) == lm.levels(counts)).mean() > 0.95
    assert (f.levels(keys ^ np.uint64(1 << 50)) > 0).mean() < 0.05
    exact = np.arange(1, 4)
    assert lm.middle(lm.levels(exact)).tolist() == [1, 2, 3]


def test_thin_keys_round_trip():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 500).astype(np.uint64))
    assert lm.thick(lm.thin(keys)).tolist() == keys.tolist()
    assert lm.thick(lm.thin(keys[:0])).tolist() == []


def test_held_out_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    r = lm.score_documents(docs, ~held).where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_without_training(spark):
    r = lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isclose(r.base_score, 0.0)
