"""Empty tables, nulls in any column, empty and very long texts, ties, repeated
rows and extra columns with clashing names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swellcast.llm import bpe, exact, html, langid, lm, near, packing, simhash, substring, urls

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
CLASH = ["id", "n", "key", "digest", "train", "batch", "kept", "part", "chunk", "rep", "tid", "uses", "sig", "range", "halo", "host", "path", "rule", "label", "score", "group", "size", "component_id", "keep_id"]
DOCS = [(1, "the cat sat on the mat today", "en"), (1, "the cat sat on the mat today", "en"), (2, "the cat sat on the mat today", None), (3, None, "en"), (4, "", "de"),
        (5, LONG, "en"), (6, LONG, "en"), (None, "eine katze sitzt auf der matte", "de"), (None, None, None), (7, "12 34 --", None), (8, "\n\t ", "de"), (9, "Ünï 漢字 🙂\x00", None)]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in CLASH)])

OPERATORS = {
    "simhash": simhash.compare_with_edits,
    "fingerprints": simhash.fingerprint_documents,
    "packing": packing.pack_documents,
    "exact": exact.exact_dedup,
    "near": near.near_dedup,
    "langid": lambda d: langid.identify(d, langid.train(d, F.lit(True))),
    "substring": lambda d: substring.remove_repeats(d, keep_text=True),
    "lm": lambda d: lm.score_documents(d, F.col("doc_id") > 1),
    "bpe": lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
}


def table(spark, rows):
    return spark.createDataFrame([r + (None,) * len(CLASH) if i % 2 else r + ("x",) * len(CLASH) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    got = OPERATORS[name](table(spark, DOCS)).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    want = sorted(-1 if i is None else i for i, _, _ in DOCS)
    assert sorted(set(ids)) == sorted(set(want)) if name == "packing" else ids == want
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    if name == "simhash":
        assert by[1][0].fingerprint == by[2][0].fingerprint and by[3][0].n_chars == 0 and by[3][0].fingerprint == "0" * 32
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if name == "packing":
        assert sum(r.n_tokens for r in by[5]) == 30_001 and [r.n_tokens for r in by[3] + by[4] + by[8]] == [1, 1, 1]
    if name == "exact":
        assert sorted((r.keep_id, r.kept) for r in by[1]) == [(2, False)] * 2 and by[5][0].keep_id == 6 and by[3][0].keep_id == 4
    if name == "near":
        assert {r.component_id for r in by[1] + by[2]} == {1} and by[6][0].component_id == 5 and by[3][0].kept and by[4][0].kept
        assert by[7][0].n_shingles == 1 and by[8][0].n_shingles == 0 and all(r.component_id is None and r.kept for r in by[None])
    if name == "langid":
        assert [by[k][0].lang_pred for k in (3, 4, 7, 8)] == ["und"] * 4 and by[1][0].lang_pred == "en" and by[9][0].lang_pred in ("en", "de")
    if name == "substring":
        assert by[5][0].n_removed == 0 and by[6][0].n_removed == 30_000 and by[6][0].kept == "" and by[2][0].n_removed == 0 and by[3][0].n_words == 0
    if name == "lm":
        assert by[3][0].n_tokens == 1 and by[5][0].n_tokens == 30_001 and len({r.score for r in by[1]}) == 1
        assert {r.train_tokens for r in got} == {sum(len((t or "").split()) + 1 for i, t, _ in DOCS if i is not None and i > 1)}
    if name == "bpe":
        assert by[3][0].n_tokens == by[4][0].n_tokens == 0 and by[5][0].n_tokens > 30_000


PAGES = [(1, "http://a.com/", "<p>x, y</p>"), (1, "http://a.com/", "<p>x, y</p>"), (None, None, None), (2, "", ""), (3, "http://b.net/es/", "<p>" + LONG), (4, "http://c.org/?a=1&b", "<nav>menu</nav>")]
PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                            *(T.StructField(c, T.StringType()) for c in [*CLASH, "text", "n_chars", "verdict", "features", "probability"])])


def pages(spark, rows):
    return spark.createDataFrame([r + ("x",) * (len(CLASH) + 5) for r in rows], PAGE_SCHEMA)


@pytest.mark.parametrize("operator", [urls.judge, html.extract])
def test_pages(spark, operator):
    assert operator(pages(spark, [])).collect() == []
    got = operator(pages(spark, PAGES)).collect()
    assert sorted(-1 if r.page_id is None else r.page_id for r in got) == [-1, 1, 1, 2, 3, 4]
    by = {r.page_id: r for r in got}
    if operator is urls.judge:
        assert (by[1].rule, by[3].verdict, by[None].host, by[2].path) == ("com/", "block", "", "") and by[4].verdict in ("allow", "block")
    else:
        assert (by[1].text, by[None].text, by[2].n_chars, by[3].text, by[4].text) == ("x, y", "", 0, LONG, "")
