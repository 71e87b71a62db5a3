"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed against reference blocks: runs of ``BLOCK`` words of
documents, indexed by anchors. An anchor is a run of ``ANCHOR`` words with the
smallest hash in some window of ``WINDOW`` words, so two documents that share
a window share that window's anchor at the same place in it. The block that an
anchor refers to lies in the document with the smallest id that has the anchor.

* The words around a document's anchors form segments; a segment meets the
  block its anchors refer to and is factored greedily: from an anchor the
  match is extended left and right as far as both agree, and the next factor
  starts at the first anchor behind it. A factor of at least ``WINDOW`` words
  of a smaller document is a duplicate span.
* At factor borders some windows hold the anchor but reach beyond the factor;
  they may still begin in another, later document with a smaller id. Exactly
  these windows are compared by 128-bit hashes across all documents: a window
  is a duplicate when a smaller id has it too.

Identical texts are collapsed first (a copy of a text of at least ``WINDOW``
words is removed whole). Nothing is grouped by anchor: the reference of an
anchor is a map-side aggregated minimum, and blocks and segments meet in a
plain join that adaptive execution splits, so a passage in a third of all
documents stays spread out.

Defined results: null text has no words; words are kept joined by one space; a
document shorter than ``WINDOW`` words keeps all; windows are judged on the
input; windows repeated inside one document alone are kept; rows that repeat
an id are one document to each other (nothing of them is removed because of
the other); a null id counts as the largest; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, stored, texts_of
from .words import U, grams, mix, words

WINDOW = 50
ANCHOR = 10
BLOCK = 256
NO_ID = (1 << 63) - 1


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of every anchor: the windows
    whose leftmost smallest run starts at the position."""
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none, none
    g = grams(h, anchor)
    width = window - anchor + 1
    low = _least(g, width)
    place = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    first, last = place, np.append(place[1:], len(low)) - 1
    return low[first], g[low[first]], first, last


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of every run of ``width``, by doubling."""
    at, span = np.arange(len(g)), 1
    while span * 2 <= width:
        a, b = at[:len(at) - span], at[span:]
        at = np.where(g[b] < g[a], b, a)
        span *= 2
    n = len(g) - width + 1
    a, b = at[:n], at[width - span:width - span + n]
    return np.where(g[b] < g[a], b, a)


def window_keys(h: np.ndarray, start: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Two 64-bit hashes of each window that begins at ``start``."""
    a, b = np.zeros(len(start), U), np.zeros(len(start), U)
    for i in range(window):
        w = h[start + i]
        a = mix(a * U(0x9E3779B97F4A7C15) + w + U(i))
        b = mix(b * U(0xC2B2AE3D27D4EB4F) ^ (w + U(0x5851F42D4C957F2D * (i + 1) & 0xFFFFFFFFFFFFFFFF)))
    return np.stack([a, b], 1)


def factors(mine: list[bytes], block: list[bytes], anchors_: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, end, anchor's place in the block) of a
    segment against a block: one per anchor that no earlier factor with the
    same alignment covers. Anchors are (place in segment, place in block)."""
    out: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}  # alignment -> end of its last factor
    for p, q in anchors_:
        if done.get(q - p, -1) > p:
            continue
        lo, hi = p, p
        while lo > 0 and lo + q - p > 0 and mine[lo - 1] == block[lo - 1 + q - p]:
            lo -= 1
        while hi < len(mine) and hi + q - p < len(block) and mine[hi] == block[hi + q - p]:
            hi += 1
        out.append((lo, hi, q - p))
        done[q - p] = hi
    return out


SEGMENT = "struct<id:long,tid:int,ref:long,block:long,start:long,body:binary,pos:array<long>,ref_pos:array<long>,low:array<long>,high:array<long>>"
PARSED = f"id long, tid int, n_words long, whole string, body binary, blocks array<struct<block:long,start:long,body:binary>>, segments array<{SEGMENT}>"
_LIST = pa.list_(pa.int64())
_PARSED = pa.schema([("id", pa.int64()), ("tid", pa.int32()), ("n_words", pa.int64()), ("whole", pa.string()), ("body", pa.binary()),
                     ("blocks", pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int64()), ("body", pa.binary())]))),
                     ("segments", pa.list_(pa.struct([("id", pa.int64()), ("tid", pa.int32()), ("ref", pa.int64()), ("block", pa.int64()), ("start", pa.int64()),
                                                      ("body", pa.binary()), ("pos", _LIST), ("ref_pos", _LIST), ("low", _LIST), ("high", _LIST)])))])


def _cut(pos, low, high, ref, ref_pos, own: int, own_tid: int, w: list[bytes], window: int, block: int) -> tuple[list[dict], list[dict]]:
    """The reference blocks that a document holds, and its segments."""
    mine = (ref == own) & (ref_pos == pos)
    blocks = []
    for b in np.unique(pos[mine] // block).tolist():
        lo = max(0, b * block - window)
        blocks.append({"block": b, "start": lo, "body": b" ".join(w[lo:(b + 1) * block + window])})
    use = np.flatnonzero(~mine)
    use = use[np.lexsort((pos[use], ref_pos[use] // block, ref[use]))]
    r, b, p = ref[use], ref_pos[use] // block, pos[use]
    new = []
    if len(use):
        far = np.diff(p) > window
        new = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(b) != 0) | far])).tolist()
    segments = []
    for lo, hi in zip(new, [*new[1:], len(use)]):
        at = use[lo:hi]
        start = max(0, int(p[lo]) - window)
        segments.append({"id": own, "tid": own_tid, "ref": int(r[lo]), "block": int(b[lo]), "start": start, "body": b" ".join(w[start:int(p[hi - 1]) + window]),
                         "pos": pos[at], "ref_pos": ref_pos[at], "low": low[at], "high": high[at]})
    return blocks, segments


def _factored(mine: list[bytes], block: list[bytes], s: dict, start: int, window: int) -> tuple[list[tuple], np.ndarray]:
    """Repeated spans of a segment, and the starts of the windows that hold an
    anchor but are not inside its factor."""
    found = factors(mine, block, list(zip((s["pos"] - s["start"]).tolist(), (s["ref_pos"] - start).tolist())))
    spans, border = [], []
    for p, q, low, high in zip(s["pos"], s["ref_pos"], s["low"], s["high"]):
        at = p - s["start"]
        shift = q - start - at
        lo, hi = next(((lo, hi) for lo, hi, d in found if d == shift and lo <= at < hi), (at, at))
        a, z = max(low, lo + s["start"]), min(high, hi + s["start"] - window)
        if a > z:
            border.append(np.arange(low, high + 1))
            continue
        if s["id"] > s["ref"]:
            spans.append((int(a), int(z) + window))
        border.append(np.concatenate([np.arange(low, a), np.arange(z + 1, high + 1)]))
    return spans, np.concatenate(border)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(parsed, spans). ``parsed`` has one row per document: id, tid (its
    text's hash), n_words, whole (digest of all words), body (its words, where
    any may be repeated) and copy (a smaller id has the same text). ``spans``
    has the repeated word ranges per (id, tid), copies left out."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor must fit into a window")
    base = (frame(docs, id_col, text_col).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
            .withColumn("tid", F.hash("text")).select("id", "tid", "text"))
    digests = stored(base.select("id", "tid", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "digests")
    copies = stored(digests.join(digests.groupBy("digest").agg(F.min("id").alias("first")), "digest").where("id > first")
                    .select("id", "tid").distinct(), "copies")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = words(texts_of(part))
            h = w.hashes()
            found = [anchors(h[a:b], window, anchor) for a, b in zip(w.ptr, w.ptr[1:])]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            cat = lambda k, t: np.concatenate([f[k] for f in found]).astype(t)
            yield pa.RecordBatch.from_arrays([part.column("id").take(owner), part.column("tid").take(owner), pa.array(cat(1, U).view(np.int64)),
                                              *(pa.array(cat(k, np.int32)) for k in (0, 2, 3))], ["id", "tid", "anchor", "pos", "low", "high"])

    # a copy has the anchors of its first text, so it changes no minimum
    every = stored(base.mapInArrow(find, "id long, tid int, anchor long, pos int, low int, high int"), "anchors")
    # (stored: a join on a plain scan can be split where an anchor is hot)
    origin = stored(every.groupBy("anchor").agg(F.min("id").alias("ref"), F.max("id").alias("most"), F.min_by("pos", "id").alias("ref_pos"))
                    .where("ref < most").select("anchor", "ref", "ref_pos"), "origins")
    uses = (every.join(origin, "anchor").join(copies, ["id", "tid"], "left_anti")
            .groupBy("id", "tid").agg(F.collect_list(F.struct("pos", "low", "high", "ref", "ref_pos")).alias("uses")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            listed = part.column("uses")
            size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            flat = listed.flatten()
            field = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            end, rows = np.cumsum(size), []
            for k, (i, t, text) in enumerate(zip(part.column("id").to_pylist(), part.column("tid").to_pylist(), texts_of(part))):
                w = text.encode("utf-8", "surrogatepass").split()
                whole = b" ".join(w)
                blocks, segments = _cut(*(f[end[k] - size[k]:end[k]] for f in field), i, t, w, window, block) if size[k] else ([], [])
                rows.append((i, t, len(w), hashlib.sha256(whole).hexdigest(), whole if segments else None, blocks, segments))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PARSED)], schema=_PARSED)

    parsed = stored(base.join(uses, ["id", "tid"], "left").mapInArrow(parse, PARSED), "parsed")
    blocks = parsed.select(F.col("id").alias("ref"), F.explode("blocks").alias("b")).select("ref", "b.block", F.col("b.start").alias("from"), F.col("b.body").alias("words"))
    segments = parsed.select(F.explode("segments").alias("s")).select("s.*")

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[list] = [[], [], [], [], [], []]
            for s in part.to_pylist():
                for c in ("pos", "ref_pos", "low", "high"):
                    s[c] = np.asarray(s[c], np.int64)
                spans, border = _factored(s["body"].split(), s["words"].split(), s, s["from"], window)
                keys = np.zeros((0, 2), np.int64)
                if len(border):
                    w = words([s["body"].decode("utf-8", "surrogatepass")])
                    keys = window_keys(w.hashes(), border - s["start"], window).view(np.int64)
                n, m = len(spans), len(border)
                for col, x, y in zip(out, ([s["id"]] * n, [s["tid"]] * n, [a for a, _ in spans], [z for _, z in spans], [None] * n, [None] * n),
                                     ([s["id"]] * m, [s["tid"]] * m, border.tolist(), (border + window).tolist(), keys[:, 0].tolist(), keys[:, 1].tolist())):
                    col += x
                    col += y
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out)], ["id", "tid", "lo", "hi", "k1", "k2"])

    matched = stored(segments.join(blocks, ["ref", "block"]).mapInArrow(factor, "id long, tid int, lo long, hi long, k1 long, k2 long"), "factors")
    border = matched.where("k1 IS NOT NULL")
    again = stored(border.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most"), "windows")
    spans = (matched.where("k1 IS NULL").select("id", "tid", "lo", "hi")
             .unionByName(border.join(again, ["k1", "k2"]).where("id > least").select("id", "tid", "lo", "hi")))
    flagged = parsed.select("id", "tid", "n_words", "whole", "body").join(copies.withColumn("copy", F.lit(True)), ["id", "tid"], "left")
    return flagged.withColumn("copy", F.coalesce("copy", F.lit(False))), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every document and, with
    ``keep_text``, tid (hash of its text) and kept: its remaining words joined
    by one space, null where nothing was removed."""
    parsed, spans = repeated_spans(docs, id_col, text_col, window)
    listed = spans.groupBy("id", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            size = pc.fill_null(pc.list_value_length(part.column("spans")), 0).to_numpy(zero_copy_only=False)
            flat, end = part.column("spans").flatten(), np.cumsum(size)
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k, (i, t, n, whole, body, copy) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "tid", "n_words", "whole", "body", "copy")))):
                removed, kept = 0, None
                if copy and n >= window:
                    removed, kept = n, b""
                elif size[k]:
                    own = slice(end[k] - size[k], end[k])
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, lo[own], 1)
                    np.add.at(edge, hi[own], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, kept = int(gone.sum()), b" ".join(w for w, g in zip(body.split(), gone.tolist()) if not g)
                rows.append((None if i == NO_ID else i, t, n, removed, whole if kept is None else hashlib.sha256(kept).hexdigest(),
                             None if kept is None else kept.decode("utf-8", "surrogatepass")))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)],
                                             ["id", "tid", "n_words", "n_removed", "kept_sha256", "kept"])

    out = (parsed.join(listed, ["id", "tid"], "left").select("id", "tid", "n_words", "whole", "body", "copy", "spans")
           .mapInArrow(apply, "id long, tid int, n_words long, n_removed long, kept_sha256 string, kept string"))
    out = out if keep_text else out.drop("tid", "kept")
    return out.withColumnRenamed("id", id_col)


# DuckDB, over all windows; for comparing on small tables
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
