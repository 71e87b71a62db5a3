import random

import numpy as np
from brute import tokens

from swellcast.llm import fuse
from swellcast.llm.words import grams, words

TEXTS = ["", "one", "  A b\tc\x0bd\r\n", "äöü é\xa0x \x1cy", "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999, " ".join("w%d" % i for i in range(300))]


def test_words_match_the_pattern():
    for lower in (False, True):
        w = words(TEXTS, lower)
        for i, t in enumerate(TEXTS):
            own = [w.buf[a:b].tobytes() for a, b in zip(w.start[w.ptr[i]:w.ptr[i + 1]], w.end[w.ptr[i]:w.ptr[i + 1]])]
            assert own == tokens(t, lower)


def test_hashes_follow_the_bytes():
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20))) for _ in range(3000)] + ["y" * 2000, "y" * 2001]
    h = words([" ".join(pool)]).hashes()
    seen = dict(zip(pool, h.tolist()))
    assert [seen[p] for p in pool] == h.tolist()
    assert len(set(seen.values())) == len(seen)


def test_grams_depend_on_order():
    a, b = (words([t]).hashes() for t in ("a b c d", "a c b d"))
    assert len(grams(a, 3)) == 2 and not set(grams(a, 2)) & set(grams(b, 2))
    assert len(grams(a, 5)) == 0


def test_fuse_filter():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 30_000).astype(np.uint64))
    for n in (1, 2, 3, 10, 1000, len(keys)):
        f = fuse.build(keys[:n])
        assert fuse.contains(keys[:n], *f).all()
    assert fuse.contains(keys + np.uint64(1), *f).mean() < 0.01
    assert len(f[3]) < 1.4 * len(keys)
