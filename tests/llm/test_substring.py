import random

import numpy as np
import pytest
from brute import sha, without_repeats

from swellcast.llm import substring


def shared_passages(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghijkl") + rnd.choice("mnop")
    passages = [[word() for _ in range(rnd.choice([49, 50, 51, 80, 300]))] for _ in range(8)]
    docs = {}
    for k in range(60):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += [word() for _ in range(rnd.randint(0, 60))]
            p = rnd.choice(passages)
            if rnd.random() < 0.3:
                p = list(p)
                p[rnd.randrange(len(p))] = "edit"
            if rnd.random() < 0.3:
                p = p[rnd.randint(0, 20):]
            w += p
        docs[k * 3] = rnd.choice([" ", "\n", "  "]).join(w)
    docs[1000], docs[1001] = docs[3], docs[6]  # copies
    docs[1002] = " ".join(["same"] * 400)  # a window that repeats inside
    docs[1003] = " ".join(["same"] * 120)
    docs[1004], docs[1005] = "short text", "short text"
    docs[1006], docs[1007] = None, ""
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_windows(spark, seed):
    docs = shared_passages(seed)
    got = substring.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), keep_text=True).collect()
    want = without_repeats(docs)
    assert len(got) == len(docs)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, sha(kept)), r.doc_id
        assert r.kept is None if not gone else r.kept.encode() == kept


def test_anchor_of_every_window():
    h = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint64)
    pos, key, low, high = substring.anchors(h, 20, 4)
    assert low.tolist() == [0, *(high[:-1] + 1).tolist()] and high[-1] == 480
    g = substring.grams(h, 4)
    for p, k, a, b in zip(pos, key, low, high):
        for i in (a, b):
            assert g[i:i + 17].argmin() + i == p and g[p] == k


def test_greedy_factors():
    a, b = b"x a b c y d e".split(), b"a b c d e".split()
    assert substring.factors(a, b, [(2, 1), (3, 2), (5, 3)]) == [(1, 4, -1), (5, 7, -2)]
