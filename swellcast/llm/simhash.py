"""SimHash fingerprints of documents and search within a Hamming radius.

Fingerprint: the terms of a text are its words (A-Z lower-cased) and its runs
of three consecutive words; every distinct term has a 128-bit hash whose bits
vote +weight or -weight, and the sign of each bit's total is the fingerprint's
bit. A run weighs 1 and a word 1/4, each times 1 + log2(count), so common
words cannot drown the rest.

Search: the bits are cut into blocks and for every choice of ``blocks -
radius`` blocks one permuted table brings those blocks to the front; two
fingerprints within the radius agree on all front blocks of at least one
table, so an equi-join on the front blocks finds every partner (pigeonhole,
no miss). Equal fingerprints are collapsed before, so copies never pair up.

Defined results: null text counts as empty; a text without words has the
all-zero fingerprint; equal texts have equal fingerprints; rows with a null id
are ordered first; rows that repeat an id are ordered by text; other columns
are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, stored, texts_of
from .words import U, grams, mix, words

BITS = 128
ROWS_PER_RANGE = 4_000  # documents of one id range; bounds a group's memory


def _votes(terms: np.ndarray, weight: float) -> np.ndarray:
    term, count = np.unique(terms, return_counts=True)
    total = np.zeros(BITS)
    for lo in range(0, len(term), 4096):
        t = term[lo:lo + 4096]
        w = (weight * (1 + np.log2(count[lo:lo + 4096]))).astype(np.float32)
        bits = np.unpackbits(np.stack([t, mix(t ^ U(0xA5A5A5A5DEADBEEF))], 1).view(np.uint8), axis=1)
        total += w @ bits.astype(np.float32) * 2.0 - float(w.sum())
    return total


def fingerprints(texts: list[str]) -> np.ndarray:
    """(n, 16) bytes: the fingerprint of every text."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    w = words(texts, lower=True)
    h = w.hashes()
    for i in range(len(texts)):
        own = h[w.ptr[i]:w.ptr[i + 1]]
        if len(own):
            out[i] = np.packbits(_votes(own, 0.25) + _votes(grams(own, 3), 1.0) > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(1) / BITS


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (32 hex digits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([f.tobytes().hex() for f in fingerprints(texts_of(part))])],
                                             ["id", "fingerprint"])

    return frame(docs, id_col, text_col).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, other: str) -> str:
    """The last quarter of ``text`` gives way to as much of ``other``'s start."""
    n = len(text) // 4
    return text[:len(text) - n] + other[:n]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprint each text and its edited text (see :func:`edited`, with the
    next document by id, after the last the first), and compare.

    Rows are dealt into id ranges of about ``rows_per_range`` documents; each
    range also gets the first document of the range that follows, so ranges
    are worked independently and nothing is ordered in one task."""
    base = frame(docs, id_col, text_col)
    n = base.count()
    cuts = max(1, -(-n // rows_per_range))
    bounds = sorted(set(base.approxQuantile("id", [i / cuts for i in range(1, cuts)], 0.2 / cuts))) if cuts > 1 else []
    # a row's range: how many bounds are <= its id (null: the first range)
    ranged = base.withColumn("range", F.lit(0))
    if bounds:
        table = np.array(bounds, np.int64)

        @F.pandas_udf("int")
        def place(ids: pd.Series) -> pd.Series:
            known = ids.notna()
            return pd.Series(np.where(known, np.searchsorted(table, ids.fillna(0).astype("int64"), "right"), 0).astype(np.int32))

        ranged = base.withColumn("range", place("id"))
    # the first id of each range: as many rows as ranges
    ids = ranged.groupBy("range").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("first")).orderBy("range").collect()
    halo = {r["first"]: ids[i - 1]["range"] for i, r in enumerate(ids)}  # after the last range: the first
    if not halo:
        return base.sparkSession.createDataFrame([], f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    goes_to = base.sparkSession.createDataFrame([(int(k), int(v)) for k, v in halo.items()], "first long, range int")
    firsts = (base.withColumn("first", F.coalesce("id", F.lit(-(1 << 63)))).join(F.broadcast(goes_to), "first")
              .groupBy("first", "range").agg(F.min(F.struct("id", "text")).alias("row"))
              .select("row.id", "row.text", "range", F.lit(True).alias("halo")))
    both = ranged.withColumn("halo", F.lit(False)).unionByName(firsts)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf["halo"]].sort_values(["id", "text"], na_position="first")
        texts = own["text"].tolist()
        after = texts[1:] + [pdf.loc[pdf["halo"], "text"].iat[0]]
        changed = [edited(t, o) for t, o in zip(texts, after)]
        mine, theirs = _chunked(texts + after[-1:]), _chunked(changed)
        return pd.DataFrame({
            "id": own["id"].astype("Int64").to_numpy(object), "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
            "fingerprint": [f.tobytes().hex() for f in mine[:-1]], "edited_fingerprint": [f.tobytes().hex() for f in theirs],
            "near_edited": likeness(mine[:-1], theirs), "near_next": likeness(mine[:-1], mine[1:])})

    out = both.groupBy("range").applyInPandas(one, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _chunked(texts: list[str], most: int = 4 << 20) -> np.ndarray:
    parts, run, size = [], [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            parts.append(fingerprints(run))
            run, size = [], 0
    parts.append(fingerprints(run))
    return np.concatenate(parts)


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None, id_col: str = "doc_id",
                  fp_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """All fingerprints within ``radius`` bits of each other, by permuted block
    tables. Returns (pairs of distinct fingerprints ``a < b`` with their
    distance, membership ``id, fingerprint``); copies share a fingerprint and
    are not expanded into pairs."""
    blocks = blocks or radius + 2
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be below the number of blocks")
    members = stored(prints.select(prints[id_col].alias("id"), prints[fp_col].alias("fingerprint")), "prints")
    distinct = members.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    tables = list(combinations(range(blocks), blocks - radius))

    def permuted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(map(bytes.fromhex, pdf["fingerprint"])), np.uint8).reshape(-1, BITS // 8), axis=1)
            for k, front in enumerate(tables):
                lead = np.packbits(np.concatenate([bits[:, edges[f]:edges[f + 1]] for f in front], 1), axis=1)
                yield pd.DataFrame({"part": k, "lead": [x.tobytes() for x in lead], "fingerprint": pdf["fingerprint"]})

    table = distinct.mapInPandas(permuted, "part int, lead binary, fingerprint string")

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(map(bytes.fromhex, s)), np.uint8).reshape(-1, BITS // 8) for s in (a, b))
        return pd.Series(np.unpackbits(x ^ y, axis=1).sum(1).astype(np.int32))

    left, right = (table.select("part", "lead", F.col("fingerprint").alias(n)) for n in ("a", "b"))
    pairs = (left.join(right, ["part", "lead"]).where("a < b").select("a", "b").distinct()
             .withColumn("distance", distance("a", "b")).where(F.col("distance") <= radius))
    return pairs, members
