import re

from pyspark.sql import functions as F

from swellcast.llm import urls

URLS = ["http://a.com/x", "http://EXAMPLE.com/en/1", "https://www.example.com/en/1?q=/es/", "https://x.www.example.com/en/", "http://example.com", "http://example.com/fr/",
        "http://notexample.com/en/", "ftp://b.net/es/1", "http://b.net/ES/1", "http://net/fr/", "http://b.net?x=/es/", "no scheme", None, "", "://h/p", "http://h.org/a#b://c/d",
        "http://com/", "http://Ä.org/p", "http://u://v.net/es/", "http://example.org/" + "a" * 20_000]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for rule, verdict in urls.RULES:
        own, _, prefix = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_trees(spark):
    rows = list(enumerate(URLS * 3))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_held_out_labelled_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = urls.split_url(F.col("url"))
    known = pages.withColumn("verdict", urls.decide(host, path, urls.RULES, 1)).where("verdict IS NOT NULL")
    held = known.where("page_id % 3 = 0")
    out = urls.judge(held, rules=(("nowhere.invalid/", "allow"),), labels=known.where("page_id % 3 <> 0").select("url", "verdict"))
    right = out.alias("o").join(held.alias("h"), "page_id").agg(F.avg((F.col("o.verdict") == F.col("h.verdict")).cast("int"))).first()[0]
    assert right > 0.9


def test_one_kind_only(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/"), (3, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(df).collect()} == {"allow"}


def test_block_rates_count_labelled_urls_outside_the_sample(spark):
    """Hosts whose labelled urls the sample of the fit hardly meets."""
    rows = [(f"http://{kind}{k}.org/{x}", verdict) for kind, verdict in (("a", "allow"), ("b", "block")) for k in range(150) for x in range(6)]
    labels = spark.createDataFrame([(u.replace("/a", "/h").replace("/b", "/g") if k % 2 else u, v) for k, (u, v) in enumerate(rows)], "url string, verdict string")
    seen = {}
    keep = urls.VectorAssembler.transform

    def spy(self, df, *args):
        seen.setdefault("frames", []).append(df)
        return keep(self, df, *args)

    urls.VectorAssembler.transform = spy
    try:
        pages = labels.selectExpr("CAST(row_number() OVER (ORDER BY url) AS LONG) AS page_id", "url")
        urls.judge(pages, rules=(("nowhere.invalid/", "allow"),), labels=labels, max_train=200)
    finally:
        urls.VectorAssembler.transform = keep
    want = {}
    for u, v in (tuple(r) for r in labels.collect()):
        want.setdefault(u.split("/")[2], []).append(v == "block")
    got = {r.host: r.f_domain_rate for r in seen["frames"][1].select("host", "f_domain_rate").distinct().collect()}
    assert got.keys() == want.keys() and all(abs(got[h] - (sum(x) + 2) / (len(x) + 4)) < 1e-9 for h, x in want.items())
