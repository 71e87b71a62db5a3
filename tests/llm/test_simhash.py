import numpy as np
import pandas as pd
from brute import sha

from swellcast.llm import simhash


def test_edits_follow_the_next_document(spark):
    rows = [(5, "abcdefgh" * 9), (1, "some words that make a text " * 4), (9, "ü"), (7, None), (3, "the third text, é, of all " * 3)]
    got = {r.doc_id: r for r in simhash.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_range=2).collect()}
    order = sorted((k, t or "") for k, t in rows)
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        n = len(t) // 4
        assert got[k].n_chars == len(t)
        assert got[k].edited_sha256 == sha(t[:len(t) - n] + nxt[:n])
        own, ed, after = (simhash.fingerprints([x])[0] for x in (t, t[:len(t) - n] + nxt[:n], nxt))
        assert got[k].fingerprint == own.tobytes().hex() and got[k].edited_fingerprint == ed.tobytes().hex()
        for value, other in ((got[k].near_edited, ed), (got[k].near_next, after)):
            assert value == 1 - np.unpackbits(own ^ other).sum() / 128


def test_separates_edited_from_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = simhash.compare_with_edits(docs).toPandas()
    assert r["near_edited"].mean() > r["near_next"].mean() + 0.2


def test_radius_search_finds_every_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    prints = [base]
    for flips in (1, 2, 3, 4, 5):
        bits = np.unpackbits(base, axis=1)
        for row in bits:
            row[rng.choice(128, flips, replace=False)] ^= 1
        prints.append(np.packbits(bits, axis=1))
    p = np.concatenate([*prints, base[:5]])
    hexes = [x.tobytes().hex() for x in p]
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(p)), "fingerprint": hexes}))
    pairs, members = simhash.within_radius(df, 4)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(hexes) for b in hexes[i + 1:]
            if a != b and bin(int(a, 16) ^ int(b, 16)).count("1") <= 4}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 100
    assert members.count() == len(p)
