"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The state of a word's prefix is the *last token* of the prefix's encoding: the
encoding of a prefix is that of the prefix without its last token, plus that
token. So the distinct new words of a batch are put in order (a depth-first
walk of their trie), and each trie node gets its last token once, however many
words share the prefix. A token may follow another when no merge across their
border comes before the merges that formed the two (checked along the right
spine of the one and the left spine of the other, and remembered).

Defined results: null text counts as empty and gives no ids; texts of any
length are encoded whole; an added token's string in a text becomes its id, as
the tokenizers library does; extra columns are never read; rows may repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, texts_of

SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NEVER = 1 << 60
MAX_CACHED_WORDS = 400_000  # memory bound only; words beyond it are encoded again


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable
    Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    ids: dict[bytes, int]
    rank: dict[int, int]  # left << 32 | right -> order of the merge
    halves: dict[int, tuple[int, int, int]]  # token -> left, right, order
    added: dict[str, int]

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read a byte-level BPE ``tokenizer.json``."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in {a["content"] for a in spec["added_tokens"]}}
        rank, halves = {}, {}
        for order, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = ids[left], ids[right], ids[left + right]
            rank[a << 32 | b] = order
            halves.setdefault(whole, (a, b, order))
        return Vocabulary(ids, rank, halves, {a["content"]: a["id"] for a in spec["added_tokens"]})


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.v = vocab
        self.size = {i: len(b) for b, i in vocab.ids.items()}
        self.bytes = {i: b for b, i in vocab.ids.items()} | {i: s.encode() for s, i in vocab.added.items()}
        self.starts = {b[:n] for b in vocab.ids for n in range(1, len(b) + 1)}
        self.endings: dict[bytes, list[tuple[int, int]]] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True))) + ")") if vocab.added else None
        self.right_spine, self.left_spine = lru_cache(None)(self._right), lru_cache(None)(self._left)
        self.follows: dict[int, bool] = {}

    def _right(self, t: int) -> tuple[tuple[int, int], ...]:
        """Tokens at the right border while ``t`` is formed, each with the order
        of the merge that replaces it."""
        out, end = [], NEVER
        while True:
            out.append((t, end))
            if t not in self.v.halves:
                return tuple(reversed(out))
            _, t, end = self.v.halves[t]

    def _left(self, t: int) -> tuple[tuple[int, int], ...]:
        out, end = [], NEVER
        while True:
            out.append((t, end))
            if t not in self.v.halves:
                return tuple(reversed(out))
            t, _, end = self.v.halves[t]

    def _may_follow(self, a: int, b: int) -> bool:
        xs, ys, i, j = self.right_spine(a), self.left_spine(b), 0, 0
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            q = self.v.rank.get(x << 32 | y, NEVER)
            if q < x_end and q <= y_end and q != NEVER:
                return False
            if x_end == y_end == NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def learn(self, fresh: set[str]) -> None:
        """Encode new words along their trie, in depth-first order."""
        ids, follows, size = self.v.ids, self.follows, self.size
        last, match = [-1], [0]  # by depth: last token; longest suffix that starts some token
        starts, endings = self.starts, self.endings
        before = b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in fresh):
            shared, most = 0, min(len(before), len(raw))
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            del last[shared + 1:], match[shared + 1:]
            m = match[-1]
            for d in range(shared + 1, len(raw) + 1):
                m += 1
                while (piece := raw[d - m:d]) not in starts:
                    m -= 1
                match.append(m)
                tokens = endings.get(piece)
                if tokens is None:  # tokens that this piece ends with, longest first
                    tokens = endings[piece] = [(n, ids[piece[-n:]]) for n in range(m, 0, -1) if piece[-n:] in ids]
                for n, t in tokens:
                    if n == d:
                        break
                    key = last[d - n] << 32 | t
                    ok = follows.get(key)
                    if ok is None:
                        ok = follows[key] = self._may_follow(last[d - n], t)
                    if ok:
                        break
                last.append(t)
            out, d = [], len(raw)
            while d:
                out.append(last[d])
                d -= size[last[d]]
            self.words[word] = array("I", out[::-1]).tobytes()
            before = raw

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > MAX_CACHED_WORDS:
            self.words.clear()
        if len(self.follows) > 4 * MAX_CACHED_WORDS:
            self.follows.clear()
        cut, added = self.split.findall, self.v.added
        tokens = [[cut(p) if p not in added else p for p in self.added.split(t)] if self.added and self.added.search(t) else [cut(t)] for t in texts]
        fresh = {w for parts in tokens for p in parts if type(p) is list for w in p}
        self.learn(fresh.difference(self.words))
        get = self.words.__getitem__
        return [b"".join(b"".join(map(get, p)) if type(p) is list else np.uint32(added[p]).tobytes() for p in parts) for parts in tokens]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text with the vocabulary at ``path`` and decode it again.

    Returns the id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``,
    the ids and the decoded text. The vocabulary (of fixed size) is broadcast."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int64())), ("decoded", pa.string())]
        schema += ", ids array<long>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocab.value)
        for part in slices(batches):
            ids = coder.encode(texts_of(part))
            decoded = [coder.decode(b) for b in ids]
            out = [part.column("id"), pa.array([len(b) // 4 for b in ids], pa.int64()),
                   pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                   pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
            if keep_ids:
                out += [pa.array([np.frombuffer(b, "<u4").astype(np.int64) for b in ids], pa.list_(pa.int64())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(out, ["id", *(n for n, _ in fields)])

    return frame(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Decode an array column of ids; null arrays give null. Other columns stay."""
    vocab = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("string")
    def text(ids):
        coder = Encoder(vocab.value)
        return ids.map(lambda a: None if a is None else coder.decode(np.asarray(a, "<u4").tobytes()))

    return rows.withColumn(out_col, text(rows[ids_col]))
