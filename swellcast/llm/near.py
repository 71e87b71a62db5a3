"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct runs of five words (A-Z lower-cased); its
signature is ``HASHES`` minima. Documents with the same set form a class, and
one of each class goes on. Signatures are cut into bands, and documents that
agree on a band share a bucket and are candidates (at similarity 0.85 a pair
misses all buckets with probability under 1e-8). A candidate pair is compared
batch by batch of its signature: after m matches in n hashes the posterior
probability of a similarity of at least the threshold, from a uniform prior,
is P(Binomial(n + 1, threshold) <= m); the pair is pruned once that falls
under ``MISS``. Survivors are verified on the words of both texts.

A bucket never turns into all its pairs. First every member meets the smallest
id of its buckets; members that are connected need no more pairs. What is then
left (members of different components in one bucket) is judged in memory, in
tiles of bounded size, and so many tiles at a time as fit a bounded number of
bytes. A pair belongs to the first band that it agrees on, so of the buckets it
shares one judges it. Tiles first get signatures alone, packed into one row a
side, and name the members that pass the posterior test with another; only
these members' texts go to the tile, where the pairs that pass are compared on
their whole sets, and a tile emits only links that join two components, so at
most one for each of its members.
So every candidate pair of different components is judged, and no link between
components is lost.

Defined results: a null or empty text has an empty set and links with nothing;
fewer than five words are one run; rows that repeat an id are one node; a row
without id is never linked; other columns are never read; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, stored, texts_of
from .graph import components
from .words import U, grams, mix, words

RUN = 5  # words of a shingle
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32  # hashes compared at a time
MISS = 1e-7
TILE = 256  # members of a tile's side
GROUP_BYTES = 8 << 20  # of the tiles that one task call holds
ROW_BYTES = 1_000  # of a tile's row without its text

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=U) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=U) * U(2)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), 1024):
        out = np.minimum(out, ((shingles[lo:lo + 1024, None] * _A + _B) >> U(32)).min(0).astype(np.uint32))
    return out


def shingle_set(word_hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    if not len(word_hashes):
        return word_hashes
    return np.unique(grams(word_hashes, min(run, len(word_hashes))))


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """Fewest matches that keep a pair alive after n hashes."""
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def alive(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions of the pairs (rows of a and b) that survive all batches."""
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for n, m in least.items():
        matches[live] += (a[live, n - BATCH:n] == b[live, n - BATCH:n]).sum(1)
        live = live[matches[live] >= m]
    return live


def similar(a: str, b: str, percent: int, run: int = RUN) -> bool:
    """Exact test on the words of both texts."""
    sets = []
    for t in (a, b):
        w = t.encode("utf-8", "surrogatepass").lower().split()
        sets.append(set(zip(*(w[i:] for i in range(run)))) if len(w) >= run else {tuple(w)} if w else set())
    inter = len(sets[0] & sets[1])
    return inter > 0 and 100 * inter >= percent * (len(sets[0]) + len(sets[1]) - inter)


def _signatures(sig) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint32).reshape(-1, HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket of each signature in each band."""
    s = sig.astype(U)
    key = np.tile(np.arange(BANDS, dtype=U), (len(s), 1))
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) ^ s[:, r::ROWS])
    return key.view(np.int64)


def _first_here(key: int, keys: np.ndarray, at: int, to: np.ndarray) -> np.ndarray:
    """Those of ``to`` that share no band with ``at`` before the one of this bucket."""
    band = np.flatnonzero(keys[at] == key)
    return to[~(keys[to, :band[0]] == keys[at, :band[0]]).any(axis=1)] if band.size and len(to) else to


def sign(docs: DataFrame, run: int) -> DataFrame:
    """id, n (set size), k1, k2 (identity of the set) and signature."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = words(texts_of(part), lower=True)
            h = w.hashes()
            sets = [shingle_set(h[a:b], run) for a, b in zip(w.ptr, w.ptr[1:])]
            key = [np.array([mix(s ^ U(c)).sum(dtype=U) for s in sets], U).view(np.int64) for c in (0x11, 0x7700)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[0]), pa.array(key[1]),
                                              pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                                             ["id", "n", "k1", "k2", "sig"])

    return docs.mapInArrow(one, "id long, n long, k1 long, k2 long, sig binary")


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Link documents whose sets have 100 * intersection >= percent * union.
    Returns id, n_shingles, component_id (smallest id reachable), kept."""
    base = frame(docs, id_col, text_col)
    least = least_matches(percent / 100)
    signed = stored(sign(base, run), "signatures")
    usable = signed.where("n > 0 AND id IS NOT NULL")
    classes = stored(usable.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = stored(usable.join(classes.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"], "left_semi")
                  .select("id", "sig").distinct(), "reps")

    def banded(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"key": band_keys(_signatures(pdf["sig"])).ravel(), "id": np.repeat(pdf["id"].to_numpy(), BANDS)})

    bands = reps.mapInPandas(banded, "key long, id long")
    shared = bands.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("most")).where("lead < most").select("key", "lead")
    members = stored(bands.join(shared, "key"), "members")
    involved = stored(members.select("id").distinct(), "involved")
    sigs = stored(reps.join(involved, "id", "left_semi"), "involved-signatures")
    texts = stored(base.join(involved, "id", "left_semi"), "texts")

    def passing(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf.iloc[alive(_signatures(pdf["sig_a"]), _signatures(pdf["sig_b"]), least)][["a", "b"]]

    def exact(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            ok = [similar(x, y, percent, run) for x, y in zip(pdf["text_a"], pdf["text_b"])]
            yield pdf.loc[ok, ["a", "b"]]

    def side(table: DataFrame, col: str, end: str) -> DataFrame:
        return table.select(F.col("id").alias(end), F.col(col).alias(f"{col}_{end}"))

    def pruned(pairs: DataFrame) -> DataFrame:
        return pairs.join(side(sigs, "sig", "a"), "a").join(side(sigs, "sig", "b"), "b").mapInPandas(passing, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(side(texts, "text", "a"), "a").join(side(texts, "text", "b"), "b").mapInPandas(exact, "a long, b long").distinct()

    pairs = stored(members.where("id <> lead").groupBy("id").agg(F.min("lead").alias("a")).select("a", F.col("id").alias("b")), "pairs")
    links = stored(verified(pruned(pairs)), "links")

    def connected(links: DataFrame) -> DataFrame:
        return stored(components(links).withColumnRenamed("component", "c"), "components")

    def still_open(joined: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with the bucket's size."""
        return _several(members.select("key", "id").join(joined, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c")), "open")

    joined = connected(links)
    open_ = still_open(joined)
    left = stored(verified(_tiles(open_, sigs, least, percent, run, texts)), "links")
    if not left.isEmpty():
        joined = connected(links.unionByName(left))
    rows = signed.select("id", "n", "k1", "k2")
    return (rows.join(classes, ["k1", "k2", "n"], "left").withColumn("node", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("rep")))
            .join(joined.select(F.col("id").alias("node"), "c"), "node", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "node", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _several(placed: DataFrame, name: str) -> DataFrame:
    """Rows (key, id, c) of the buckets that hold several components, with the bucket's size."""
    split = stored(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("top"), F.count(F.lit(1)).alias("size"))
                   .where("low < top").select("key", "size"), f"{name}-buckets")
    return stored(placed.join(split, "key"), name)


def _groups(rows: int, texts: int = 0) -> int:
    """Groups for so many tile rows and bytes of text in them."""
    return max(8, -(-(rows * ROW_BYTES + texts) // GROUP_BYTES))


def _tiles(open_: DataFrame, known: DataFrame, least: dict[int, int], percent: int, run: int = RUN, texts: DataFrame | None = None) -> DataFrame:
    """Links that join different components of one bucket. ``known`` has id and
    sig, and ``texts`` (or else ``known``) id and text. A bucket's members are
    dealt into sides of about ``TILE``; each pair of sides is one tile, judged in
    memory, and emits a forest."""
    texts = known.select("id", "text") if texts is None else texts
    sigs = known.select("id", "sig")
    sides = F.ceil(F.col("size") / TILE).cast("int")
    members_, rows = open_.agg(F.count(F.lit(1)), F.sum(sides.cast("long"))).first()
    dealt = open_.select("key", "id", "c", sides.alias("sides")).distinct().withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))

    groups_of_members = max(8, -(-(members_ or 0) * ROW_BYTES // GROUP_BYTES))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for each side: its members' ids, components and signatures."""
        out = [(key, side, part["sides"].iat[0], *(part[c].to_numpy(np.int64).tobytes() for c in ("id", "c")), b"".join(part["sig"]))
               for (key, side), part in pdf.groupby(["key", "side"], sort=False)]
        return pd.DataFrame(out, columns=["key", "side", "sides", "ids", "comps", "sigs"])

    packed = (dealt.join(sigs, "id").withColumn("deal", F.pmod(F.xxhash64("key", "side"), F.lit(groups_of_members)))
              .groupBy("deal").applyInPandas(pack, "key long, side int, sides int, ids binary, comps binary, sigs binary"))
    tiles = (packed.select("key", "side", "ids", "comps", "sigs", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
             .select("key", "ids", "comps", "sigs", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side"))
    def grouped(tiles: DataFrame, groups: int):
        return tiles.withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(groups, members_ // 500)))).groupBy("group")

    def halves(tile: pd.DataFrame, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if i == j:
            return (np.arange(len(tile)),) * 2
        return np.flatnonzero(tile["side"] == i), np.flatnonzero(tile["side"] == j)

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        """The members that pass with one of another component in their tile."""
        out = [pd.DataFrame({c: [] for c in ("key", "id", "c", "i", "j", "side", "sig")}, dtype=object)]
        for (key, i, j), sides in pdf.groupby(["key", "i", "j"], sort=False):
            ids, comp = (np.frombuffer(b"".join(sides[c]), np.int64) for c in ("ids", "comps"))
            sig = _signatures(sides["sigs"])
            tile = pd.DataFrame({"key": key, "id": ids, "c": comp, "i": i, "j": j, "side": np.repeat(sides["side"].to_numpy(), sides["ids"].map(len) // 8)})
            x, y = halves(tile, i, j)
            hit, keys = np.zeros(len(tile), bool), band_keys(sig)
            for at in x:
                to = y[(comp[y] != comp[at]) & (ids[y] > ids[at] if i == j else True)]
                to = _first_here(key, keys, at, to[alive(np.broadcast_to(sig[at], (len(to), HASHES)), sig[to], least)])
                hit[to] = True
                hit[at] |= len(to) > 0
            out.append(tile[hit].assign(sig=[row.tobytes() for row in sig[hit]]))
        return pd.concat(out)[["key", "id", "c", "i", "j", "side", "sig"]]

    passed = stored(grouped(tiles, _groups(rows or 0)).applyInPandas(screen, "key long, id long, c long, i int, j int, side int, sig binary"), "passed")
    times = passed.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    rows, size = times.join(texts.select("id", F.octet_length("text").cast("long").alias("size")), "id").agg(F.sum("times"), F.sum(F.col("times") * F.col("size"))).first()
    rows = rows or 0

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (key, i, j), tile in pdf.groupby(["key", "i", "j"], sort=False):
            ids, sig, sets = tile["id"].to_numpy(), _signatures(tile["sig"]), {}
            keys = band_keys(sig)
            _, comp = np.unique(tile["c"].to_numpy(), return_inverse=True)  # merged as links are found
            x, y = halves(tile, i, j)

            def members(at: int) -> np.ndarray:
                if at not in sets:
                    sets[at] = shingle_set(words([tile["text"].iat[at]], lower=True).hashes(), run)
                return sets[at]

            for at in x:
                to = y[(comp[y] != comp[at]) & (ids[y] > ids[at] if i == j else True)]
                for b in _first_here(key, keys, at, to[alive(np.broadcast_to(sig[at], (len(to), HASHES)), sig[to], least)]):
                    if comp[b] == comp[at]:
                        continue
                    s, t = members(at), members(b)
                    inter = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * inter >= percent * (len(s) + len(t) - inter):
                        comp[comp == comp[b]] = comp[at]
                        out.append((min(ids[at], ids[b]), max(ids[at], ids[b])))
        return pd.DataFrame(out, columns=["a", "b"])

    return grouped(passed.join(texts, "id"), _groups(rows, size or 0)).applyInPandas(compare, "a long, b long").distinct()


# DuckDB, over all shared shingles; for comparing on small tables
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
