import random

import numpy as np
import pandas as pd
import pytest
from brute import near_components

from swellcast.llm import graph, near


def near_copies(seed, groups=12, most=25):
    """Groups of texts that drift apart by word edits, so that chains of links
    form in which the ends are no longer similar."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, k = {}, 0
    for _ in range(groups):
        w = [word() for _ in range(rnd.choice([3, 5, 12, 80, 200]))]
        for _ in range(rnd.randint(1, most)):
            docs[k] = " ".join(w)
            k += 1
            if rnd.random() < 0.7:
                w = list(w)
                w[rnd.randrange(len(w))] = word()
    ids = list(docs)
    rnd.shuffle(ids)
    return dict(zip(ids, docs.values()))


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_components_equal_all_pairs(spark, seed, percent):
    docs = near_copies(seed)
    docs |= {10_000: None, 10_001: "", 10_002: " \n"}
    got = near.near_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), percent).collect()
    want = near_components(docs, percent)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(k, n, c, k == c) for k, (n, c) in want.items()}


def test_tiles_judge_every_open_pair(spark):
    """One bucket of many members without links to its leader."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefghijkl") + rnd.choice("mnopq") for _ in range(60)) for _ in range(60)]
    texts[40:50] = [t + " more" for t in texts[10:20]]  # ten links
    texts[50] = texts[10] + " other"  # a triangle: two of its three links join it
    sig = [near.signature(near.shingle_set(near.words([t]).hashes())).tobytes() for t in texts]
    known = spark.createDataFrame(pd.DataFrame({"id": range(60), "sig": sig, "text": texts}), "id long, sig binary, text string")
    members = spark.createDataFrame(pd.DataFrame({"key": 7, "id": range(60), "c": range(60), "size": 60}), "key long, id long, c long, size long")
    for tile in (256, 7):
        near.TILE, before = tile, near.TILE
        try:
            links = near._tiles(members, known, near.least_matches(0.85), 85)
            got = {r.id: r.component for r in graph.components(links).collect()}
        finally:
            near.TILE = before
        assert got == {i: i for i in range(10, 20)} | {i + 30: i for i in range(10, 20)} | {50: 10}


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(6)
    least = near.least_matches(0.85)
    for _ in range(200):
        shared, own = rng.integers(0, 1 << 62, 300), rng.integers(0, 1 << 62, 100)
        a, b = (near.signature(np.unique(np.concatenate([shared, own[o::4]]).astype(np.uint64))) for o in (0, 1))
        assert len(near.alive(a[None], b[None], least)) == 1  # similarity 300 / 350
    assert not len(near.alive(a[None], near.signature(np.arange(100, dtype=np.uint64))[None], least))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 200)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 300: 200}


def test_groups_of_tiles_are_bounded_and_texts_go_where_pairs_pass(spark, monkeypatch):
    """Members of one hot bucket that are nothing like each other, but for two."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefghijkl") + rnd.choice("mnopq") for _ in range(60)) for _ in range(600)]
    texts[1] = texts[0] + " more"
    sig = [near.signature(near.shingle_set(near.words([t]).hashes())).tobytes() for t in texts]
    known = spark.createDataFrame(pd.DataFrame({"id": range(600), "sig": sig}), "id long, sig binary")
    body = spark.createDataFrame(pd.DataFrame({"id": range(600), "text": texts}), "id long, text string")
    members = spark.createDataFrame(pd.DataFrame({"key": 7, "id": range(600), "c": range(600), "size": 600}), "key long, id long, c long, size long")
    asked, groups, stored, kept = [], near._groups, near.stored, []
    monkeypatch.setattr(near, "TILE", 60)
    monkeypatch.setattr(near, "GROUP_BYTES", 100_000)
    monkeypatch.setattr(near, "_groups", lambda *x: asked.append((x, groups(*x))) or asked[-1][1])
    monkeypatch.setattr(near, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    assert [tuple(r) for r in near._tiles(members, known, near.least_matches(0.85), 85, texts=body).collect()] == [(0, 1)]
    assert {r.id for r in kept[0].collect()} == {0, 1}
    assert asked[0] == ((6_000,), 60)  # tile rows: each of 600 members in ten tiles; 600 // 500 groups would hold thousands of rows
    assert asked[1][0][0] == 2 and asked[1][0][1] == len(texts[0]) + len(texts[1])
