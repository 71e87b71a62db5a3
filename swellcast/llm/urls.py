"""URL filtering: host and path rules, and gradient-boosted trees for the rest.

A rule is ``host/path-prefix``; it fits its host and all subdomains when the
url's path starts with the rule's path, and the longest fitting rule decides.
Urls without a rule are judged by boosted trees on lexical features (lengths,
depth, digit ratio, character entropy, hyphens, host labels, parameter counts,
and how often the suffix of the host and the first path part are blocked among
the labelled urls). The labelled urls are here those that a rule decides. The
block rates count all of them; the trees are fitted to a hash sample of about
``max_train`` rows.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged by the trees; without labelled urls of both kinds
the only kind there is (or ``allow``) is the verdict; repeated rows get equal
verdicts; other columns are never read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MAX_TRAIN = 20_000
TREES, DEPTH, RATE = 20, 4, 0.2
KEYS = ("k_suffix", "k_domain", "k_part")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or odd url."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, PARTS, 2)


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str]], what: int) -> Column:
    """The rule text (``what`` 0) or verdict (1) of the longest fitting rule, or
    null. The rule list is a parameter of bounded size."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, prefix = rule[0].partition("/")
        fits.append(F.when(((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix), F.lit(rule[what])))
    return F.coalesce(*fits, F.lit(None).cast("string"))


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Bits per character."""
    def one(t: str) -> float:
        if not t:
            return 0.0
        p = np.array(list(Counter(t).values())) / len(t)
        return float(-(p * np.log2(p)).sum())
    return text.map(one)


def keys(host: Column, path: Column) -> list[Column]:
    """The keys of the block rates."""
    labels = F.split(host, r"\.")
    return [F.element_at(labels, -1).alias("k_suffix"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("k_domain"),
            F.regexp_extract(path, r"^/([^/]*)", 1).alias("k_part")]


def lexical(urls: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add the lexical feature columns ``f_*`` and the keys ``k_*`` of the
    suffix statistics."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    labels = F.split(h, r"\.")
    longest = F.array_max(F.transform(labels, F.length))
    return urls.select(
        "*", F.length(u).alias("f_length"), F.length(h).alias("f_host_length"), F.length(p).alias("f_path_length"),
        (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).alias("f_depth"),
        ((F.length(u) - F.length(F.regexp_replace(u, "[0-9]", ""))) / n).alias("f_digit_ratio"),
        ((F.length(h) - F.length(F.regexp_replace(h, "[0-9]", ""))) / F.greatest(F.length(h), F.lit(1))).alias("f_host_digits"),
        entropy(u).alias("f_entropy"), entropy(h).alias("f_host_entropy"),
        (F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit("")))).alias("f_hyphens"),
        F.size(labels).alias("f_labels"), F.coalesce(longest, F.lit(0)).alias("f_longest_label"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).alias("f_parameters"), F.length(query).alias("f_query_length"),
        u.startswith("https:").cast("int").alias("f_https"), u.contains("#").cast("int").alias("f_fragment"),
        *keys(h, p))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
          labels: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """id, host, path, rule, verdict and score (the trees' block probability).
    ``labels`` (url, verdict) replaces the rule-decided urls as training data."""
    def parts(df: DataFrame, *cols: Column) -> DataFrame:
        host, path = split_url(df[url_col])
        return df.select(*cols, df[url_col].alias("url"), host.alias("host"), path.alias("path"))

    urls = parts(pages, pages[id_col].alias("id")).withColumns({"rule": decide(F.col("host"), F.col("path"), rules, 0),
                                                               "given": decide(F.col("host"), F.col("path"), rules, 1)})
    if labels is None:
        known = urls.where("given IS NOT NULL").select("url", "host", "path", (F.col("given") == "block").cast("double").alias("label"))
    else:
        known = parts(labels, (labels["verdict"] == "block").cast("double").alias("label")).where("label IS NOT NULL")
    n, blocked = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    blocked = blocked or 0.0
    if not 0 < blocked < n:
        only = "block" if n and blocked == n else "allow"
        return urls.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.lit(only)).alias("verdict"),
                           F.lit(float(only == "block")).alias("score"))
    share = min(1.0, max_train / n)
    sample = lexical(known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < share * 1_000_000), "url", "host", "path")
    prior = blocked / n
    # block rates of every key over all labelled urls; the tables stay distributed
    keyed = stored(known.select("label", *keys(F.col("host"), F.col("path"))), "keys")
    stats = {k: stored(keyed.groupBy(k).agg(((F.sum("label") + 4 * prior) / (F.count(F.lit(1)) + 4)).alias(f"f_{k[2:]}_rate")), f"rates-{k[2:]}") for k in KEYS}

    def featured(df: DataFrame) -> DataFrame:
        for k, table in stats.items():
            df = df.join(table, k, "left")
        return df.fillna(prior, [f"f_{k[2:]}_rate" for k in KEYS])

    names = [c for c in sample.columns if c.startswith("f_")] + [f"f_{k[2:]}_rate" for k in KEYS]
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=7, labelCol="label")
    model = trees.fit(assemble.transform(featured(sample)).select("features", "label"))
    scored = model.transform(assemble.transform(featured(lexical(urls, "url", "host", "path"))))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("given", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
