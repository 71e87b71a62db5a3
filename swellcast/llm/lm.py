"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated word bigram model (words with A-Z lower-cased,
and one end token a text). N-gram counts are quantised on a logarithmic scale,
q(c) = 1 + floor(log_b c), and an n-gram enters a Bloom filter q times, as
(n-gram, 1) to (n-gram, q). A count is read back by probing level after level
until one is missing, and stands for the middle of its last level. With the
counts c' so read, and N and V the training tokens and distinct tokens,

    P(w | v) = MIX * c'(v, w) / c'(v) + (1 - MIX) * (c'(w) + 0.5) / (N + 0.5 * (V + 1))

The filter grows with the corpus, so it is not broadcast whole: it is cut into
parts by ranges of the n-gram's hash. A part's size is bounded (the number of
parts grows), it goes to the one worker that serves the range, and the probes
come to it: a chunk (a run of documents of bounded size) asks each part once
for its distinct n-grams in one packed array, so frequent n-grams are
aggregated before anything is shuffled and no key is ever hot. The exact word
counts of the base score travel the same way.

Defined results: null text counts as empty and is one end token; without
training documents all counts are 0 and every token has the base probability
0.5 / 0.5; long texts are scored whole; repeated rows count and are scored
each; null ids stay null; other columns are never read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts_of
from .words import U, mix, words

LEVEL_BASE = 1.3
PROBES = 6  # bits of one (n-gram, level); a false positive in about 64 probes
MIX = 0.3
CHUNK_BYTES = 16 << 20
BYTES_PER_PART = 12 << 20  # of text, for one part of the filter
START_KEY, END_KEY = U(0x51A2751A27), U(0xE0DE0DE0DE)
KEY_BITS = 48  # of a bigram's key


def levels(count: np.ndarray) -> np.ndarray:
    """The quantised level of a positive count."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its whole numbers."""
    low, high = np.ceil(LEVEL_BASE ** (level - 1.0) - 1e-9), np.ceil(LEVEL_BASE ** level.astype(float) - 1e-9) - 1
    return np.where(level > 0, (low + np.maximum(low, high)) / 2, 0.0)


class LogFrequencyFilter:
    """One part of the filter, sized for its contents."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, level = keys[counts > 0], levels(counts[counts > 0])
        self.bits = max(64, math.ceil(int(level.sum()) * PROBES / math.log(2) / 8) * 8)
        self.table = np.zeros(self.bits // 8, np.uint8)
        for n in range(1, int(level.max(initial=0)) + 1):
            for at in self._bits(keys[level >= n], n):
                np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _bits(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = mix(keys + U(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF))
        step = mix(h) | U(1)
        for i in range(PROBES):
            yield ((h + U(i) * step) % U(self.bits)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probe level after level until the first miss."""
        out = np.zeros(len(keys), np.uint8)
        live, level = np.arange(len(keys)), 0
        while live.size and level < 255:
            level += 1
            hit = np.ones(len(live), bool)
            for at in self._bits(keys[live], level):
                hit &= (self.table[at >> 3] >> (at & 7) & 1).astype(bool)
            live = live[hit]
            out[live] = level
        return out


def thin(keys: np.ndarray) -> bytes:
    """Ascending 48-bit keys as differences, low and high parts apart (the high
    ones are almost all zero and compress away)."""
    d = np.diff(keys, prepend=U(0))
    return d.astype(np.uint32).tobytes() + (d >> U(32)).astype(np.uint16).tobytes()


def thick(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint32, n).astype(U) + (np.frombuffer(raw, np.uint16, n, 4 * n).astype(U) << U(32)), dtype=U)


def cuts(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Borders of the parts (equal ranges of the key space) in ascending keys."""
    borders = [(p << bits) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(borders, U)), [len(keys)]]).astype(np.int64)


class Chunk:
    """Words and bigrams of one packed run of documents."""

    def __init__(self, row) -> None:
        self.keys = np.frombuffer(row["keys"], U)  # distinct words, ascending
        self.ptr = np.frombuffer(row["ptr"], np.int64)
        self.token = np.frombuffer(row["tokens"], np.int32)
        self.train = np.frombuffer(row["train"], bool)
        # the texts one after another, each with its end token (index -1)
        n = np.diff(self.ptr)
        self.begin = self.ptr[:-1] + np.arange(len(n))
        self.word = np.full(len(self.token) + len(n), -1, np.int64)
        inner = np.ones(len(self.word), bool)
        inner[self.begin + n] = False
        self.word[inner] = self.token
        self.owner = np.repeat(np.arange(len(n)), n + 1)
        self.before = np.concatenate([[-1], self.word[:-1]])[:len(self.word)]  # -1 at a text's start: the text before ended there

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct bigram keys, ascending, and each token's place in them."""
        of = np.append(self.keys, END_KEY)
        first = np.append(self.keys, START_KEY)
        pair = mix(mix(first[self.before]) * U(3) + of[self.word]) >> U(64 - KEY_BITS)
        return np.unique(pair, return_inverse=True)


DOCS = "chunk string, known binary, ids binary, train binary, ptr binary, tokens binary, keys binary, counts binary"


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
                    chunk_bytes: int = CHUNK_BYTES, bytes_per_part: int = BYTES_PER_PART) -> DataFrame:
    """Learn from the rows where ``training`` holds and score all rows.

    Returns id, n_tokens, n_known, train_tokens, base_score (add-half unigram
    model over exact counts) and score (the log-frequency bigram model)."""
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                       F.coalesce(training, F.lit(False)).alias("train"))
    size, ends = base.agg(F.sum(F.octet_length("text")), F.sum(F.col("train").cast("long"))).first()
    ends, parts = ends or 0, max(8, math.ceil((size or 0) / bytes_per_part))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(_gathered(batches, chunk_bytes), chunk_bytes):
            train = np.asarray(part.column("train").to_pylist(), bool)
            w = words(texts_of(part), lower=True)
            keys, token = np.unique(w.hashes(), return_inverse=True)
            counts = np.bincount(token, np.repeat(train, np.diff(w.ptr)), len(keys)).astype(np.uint32)
            ids = part.column("id")
            values = [uuid.uuid4().hex, np.asarray(ids.is_valid()).tobytes(), np.asarray(ids.fill_null(0)).tobytes(), train.tobytes(),
                      w.ptr.astype(np.int64).tobytes(), token.astype(np.int32).tobytes(), keys.tobytes(), counts.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([values[0]]), *(pa.array([v], pa.binary()) for v in values[1:])],
                                             [c.split()[0] for c in DOCS.split(", ")])

    chunks = stored(base.mapInArrow(pack, DOCS), "chunks")

    def ask_words(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for chunk, raw, counts in zip(pdf["chunk"], pdf["keys"], pdf["counts"]):
                keys, count = np.frombuffer(raw, U), np.frombuffer(counts, np.uint32)
                at = cuts(keys, parts, 64)
                yield pd.DataFrame([(p, chunk, keys[lo:hi].tobytes(), count[lo:hi].tobytes()) for p, (lo, hi) in enumerate(zip(at, at[1:]))],
                                   columns=["part", "chunk", "keys", "counts"])

    def ask_bigrams(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.to_dict("records"):
                c = Chunk(row)
                keys, back = c.bigrams()
                count = np.bincount(back, c.train[c.owner], len(keys)).astype(np.uint32)
                at = cuts(keys, parts, KEY_BITS)
                yield pd.DataFrame([(p, row["chunk"], thin(keys[lo:hi]), count[lo:hi].tobytes()) for p, (lo, hi) in enumerate(zip(at, at[1:]))],
                                   columns=["part", "chunk", "keys", "counts"])

    def summed(keys: list[np.ndarray], counts) -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, np.concatenate([np.frombuffer(c, np.uint32) for c in counts]), len(key)).astype(np.int64)

    def serve_words(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [np.frombuffer(k, U) for k in pdf["keys"]]
        key, count = summed(asked, pdf["counts"])
        part = LogFrequencyFilter(key, count)
        exact = [count[np.searchsorted(key, a)] for a in asked]
        out = pdf[["part", "chunk"]].assign(exact=[e.tobytes() for e in exact], level=[part.levels(a).tobytes() for a in asked], total=0, distinct=0)
        out.loc[out.index[0], ["total", "distinct"]] = int(count.sum()), int((count > 0).sum())
        return out

    def serve_bigrams(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [thick(k) for k in pdf["keys"]]
        part = LogFrequencyFilter(*summed(asked, pdf["counts"]))
        return pdf[["part", "chunk"]].assign(pair=[part.levels(a).tobytes() for a in asked])

    asks = "part int, chunk string, keys binary, counts binary"
    word_replies = stored(chunks.select("chunk", "keys", "counts").mapInPandas(ask_words, asks).groupBy("part")
                          .applyInPandas(serve_words, "part int, chunk string, exact binary, level binary, total long, distinct long"), "words")
    pair_replies = (chunks.select("chunk", "train", "ptr", "tokens", "keys").mapInPandas(ask_bigrams, asks).groupBy("part")
                    .applyInPandas(serve_bigrams, "part int, chunk string, pair binary"))
    replies = (word_replies.select("part", "chunk", "exact", "level", F.lit(None).cast("binary").alias("pair"))
               .unionByName(pair_replies.select("part", "chunk", F.lit(None).cast("binary").alias("exact"), F.lit(None).cast("binary").alias("level"), "pair")))
    total, distinct = (x or 0 for x in word_replies.agg(F.sum("total"), F.sum("distinct")).first())
    total, distinct = total + ends, distinct + (ends > 0)
    floor = total + 0.5 * (distinct + 1)

    def finish(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        row = mine.iloc[0]
        c = Chunk(row)
        theirs = theirs.sort_values("part")
        joined = lambda col, kind: np.frombuffer(b"".join(theirs[col].dropna()), kind)
        exact = np.append(joined("exact", np.int64), ends)
        once = np.append(middle(joined("level", np.uint8)), middle(levels(np.array([ends]))) if ends else 0.0)
        _, back = c.bigrams()
        twice = middle(joined("pair", np.uint8))[back]
        flat, single = np.log10((exact + 0.5) / floor), (once + 0.5) / floor
        context = once[c.before]
        follow = np.minimum(twice, context) / np.maximum(context, 1.0)
        smooth = np.log10(MIX * follow + (1 - MIX) * single[c.word])
        ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        per_text = lambda value: np.add.reduceat(value, c.begin)  # noqa: E731  every text has its end token
        return pd.DataFrame({"id": pd.arrays.IntegerArray(ids.copy(), ~known), "n_tokens": np.diff(c.ptr) + 1,
                             "n_known": per_text((exact > 0)[c.word].astype(np.int64)), "train_tokens": total,
                             "base_score": per_text(flat[c.word]), "score": per_text(smooth)})

    return (chunks.select("chunk", "known", "ids", "train", "ptr", "tokens", "keys").groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInPandas(finish, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("id", id_col))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Join small Arrow batches up to about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(h.nbytes for h in held) + b.nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
