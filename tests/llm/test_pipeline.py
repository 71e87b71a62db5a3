import random

import corpus_pipeline as p
from brute import near_components, without_repeats
from pyspark.sql import functions as F

from swellcast.llm import langid
from swellcast.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    model = langid.train(docs, F.lit(True))
    kept = [k for k, (lang, score) in zip(text, langid.predict(list(text.values()), model)) if lang != "und" and score >= p.MIN_LANGUAGE_SCORE]
    frames, out = {}, docs
    for name, stage in p.STAGES:
        out = frames[name] = stored(stage(spark, out, SF), name)
        if name != "packing":
            assert set(out.columns) == set(docs.columns)
    now = {k: text[k] for k in kept}
    assert {r.doc_id: r.text for r in frames["language_id"].collect()} == now
    last = {t: k for k, t in sorted(now.items())}
    now = {k: t for t, k in last.items()}
    assert {r.doc_id: r.text for r in frames["exact_dedup"].collect()} == now
    now = {k: now[k] for k, (_, c) in near_components(now, 80).items() if k == c}
    assert {r.doc_id: r.text for r in frames["near_dedup"].collect()} == now
    now = {k: (now[k] if not gone else words.decode()) for k, (_, gone, words) in without_repeats(now).items() if not gone or words}
    got = frames["substring_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == now and all(r.n_chars == len(r.text) for r in got)
    packed = {}
    for r in frames["packing"].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == {k: len(t.split()) + 1 for k, t in now.items()}
    assert sorted(map(tuple, p.run(spark, SF).select("doc_id", "n_tokens", "bin", "offset").collect())) == sorted(
        map(tuple, frames["packing"].select("doc_id", "n_tokens", "bin", "offset").collect()))


def test_awkward_rows(spark):
    rows = [(1, "the cat sat on the mat " * 30, "en", None, None), (1, "the cat sat on the mat " * 30, "en", None, None), (2, None, None, "s", 0), (3, "", "en", "s", 0),
            (None, "die katze auf der matte schläft", "de", "s", 5), (4, "99 -- 11", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data, want in ((docs, [-1, 1]), (docs.limit(0), [])):
        out = data
        for name, stage in p.STAGES[:-1]:
            out = stored(stage(spark, out, SF), name)
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want
        assert p.pack(spark, out, SF).count() == len(want)


def test_texts_in_several_languages_stay(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = given.select("doc_id", "text", "lang")
    by = {r.lang: r.text.split()[:40] for r in given.where("n_chars between 800 and 2000").dropDuplicates(["lang"]).collect()}
    rnd = random.Random(1)
    letters = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10))) for _ in range(200))
    rows = [(-1, " ".join(by["en"] + by["de"] + by["fr"]), None), (-2, " ".join(sum(by.values(), [])), None), (-3, letters, None)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r.doc_id for r in p.language_id(spark, more, SF).where("doc_id < 0").collect()}
    assert len(by) == 4 and got == {-1, -2}


def test_copies_of_rows_without_or_with_a_repeated_id(spark):
    x, y, z = (f"{w} the cat sat on the mat and saw a dog" for w in ("first", "second", "third"))
    docs = spark.createDataFrame([(None, x), (7, x), (None, z), (5, y), (9, y), (5, z + " again")], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in p.exact_dedup(spark, docs, SF).collect())
    assert got == sorted([(7, x), (-1, z), (9, y), (5, z + " again")])
