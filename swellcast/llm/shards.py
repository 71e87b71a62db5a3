"""Token ids in seekable files: independent zstandard frames, one per document,
with a trailing seek table and a checksum per frame.

A file is (all integers little-endian)

* a head: skippable frame of fixed size with the file's place in the order
  (part, number), its documents and its ids;
* one zstandard frame per document with its ids as unsigned 32-bit integers (a
  document beyond ``FRAME_BYTES`` takes several frames);
* a document table: skippable frame with id, null flag and frames of each document;
* the seek table of the public seekable zstandard format: skippable frame with
  compressed size, size and checksum (low half of the content's XXH64) of every
  frame above, skippable ones with size 0, and the footer.

So any zstandard reader gets the ids of all documents in order, and a reader of
some documents takes footer, seek table and document table, then decompresses
the frames of those documents only.

Encoding, compression and checksums run where the texts are; only compressed
frames are dealt and sorted by ranges of doc_id (repeated ids by the row, so a
hot id is split too), and every task writes whole files of bounded size through
Spark's own commit protocol: a lost executor's attempt leaves nothing behind.

Defined results: null text counts as empty (its only id is the end id); null
doc_ids come first; documents of one id follow in the order of their texts'
hash, and equal rows are all written; an empty table writes no document and
reads back as none; texts of any length are encoded whole; other columns are
never read. A damaged frame, table or footer is an error when it is read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .bpe import SPLIT, byte_letters
from .common import frame, slices, stored, texts_of

# fixed values of the public seekable format
SKIPPABLE, SEEK_MAGIC, SKIP_SEEK = 0x184D2A50, 0x8F92EAB1, 0x184D2A5E
HAS_CHECKSUMS = 0x80

HEAD = "<IIIIQQQ"  # skippable magic, size, our magic, part, number, documents, ids
HEAD_SIZE = struct.calcsize(HEAD)
HEAD_MAGIC = 0x31445753
LEVEL = 3
FRAME_BYTES = 8 << 20  # of ids in a frame
FILE_BYTES = 32 << 20  # of ids in a file; a single larger document is a file of its own
END_ID = 0
WORDS = 250_000  # in each of two sets that a Python worker remembers; bounds its memory
LONGEST = 64  # of a word that is remembered


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def skippable(body: bytes, magic: int = SKIPPABLE) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


# ---------------------------------------------------------------------- writer

@dataclass
class Entry:
    """One document's frames, ready to be written: compressed bytes and, per
    frame, (compressed size, size, checksum)."""

    doc_id: int | None
    data: bytes
    frames: np.ndarray  # n x 3, uint32


def compress(ids: bytes, frame_bytes: int = FRAME_BYTES, coder: zstandard.ZstdCompressor | None = None) -> tuple[bytes, np.ndarray]:
    out, table = [], []
    coder = coder or zstandard.ZstdCompressor(level=LEVEL)
    for lo in range(0, len(ids), frame_bytes):
        raw = ids[lo:lo + frame_bytes]
        out.append(coder.compress(raw))
        table.append((len(out[-1]), len(raw), checksum(raw)))
    return b"".join(out), np.array(table, np.uint32).reshape(-1, 3)


def file_bytes(entries: list[Entry], part: int, number: int) -> bytes:
    """A complete file of the given documents."""
    ids = sum(int(e.frames[:, 1].sum(dtype=np.int64)) for e in entries) // 4
    head = struct.pack(HEAD, SKIPPABLE, HEAD_SIZE - 8, HEAD_MAGIC, part, number, len(entries), ids)
    docs = np.array([e.doc_id or 0 for e in entries], "<i8").tobytes()
    docs += np.array([e.doc_id is None for e in entries], np.uint8).tobytes() + np.array([len(e.frames) for e in entries], "<u4").tobytes()
    docs = skippable(docs)
    table = np.concatenate([np.array([[len(head), 0, checksum(b"")]], np.uint32), *(e.frames for e in entries),
                            np.array([[len(docs), 0, checksum(b"")]], np.uint32)]).astype("<u4")
    seek = skippable(table.tobytes() + struct.pack("<IBI", len(table), HAS_CHECKSUMS, SEEK_MAGIC), SKIP_SEEK)
    return b"".join([head, *(e.data for e in entries), docs, seek])


# ---------------------------------------------------------------------- reader

class Damaged(ValueError):
    """A file, table or frame that is not what was written."""


class SeekableReader:
    """Documents of one file, from any seekable binary stream. Only the tables
    are read at first, then the frames that are asked for."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream = stream
        end = stream.seek(0, io.SEEK_END)
        if end < HEAD_SIZE + 17:
            raise Damaged("the file is too short")
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise Damaged("no seek table with checksums")
        size = 12 * count + 9
        lo = end - size - 8
        if lo < 0 or struct.unpack("<II", self._at(lo, 8)) != (SKIP_SEEK, size):
            raise Damaged("the seek table does not fit its footer")
        self.table = np.frombuffer(self._at(lo + 8, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        if self.offset[-1] != lo:
            raise Damaged("the frames do not fill the file")
        kind, _, own, self.part, self.number, self.documents, self.ids = struct.unpack(HEAD, self._at(0, HEAD_SIZE))
        if (kind, own) != (SKIPPABLE, HEAD_MAGIC):
            raise Damaged("the file has another head")
        docs = self._at(int(self.offset[-2]), int(self.table[-1, 0]))[8:]
        n = self.documents
        if len(docs) != 13 * n:
            raise Damaged("the document table does not fit the head")
        null = np.frombuffer(docs, np.uint8, n, 8 * n).astype(bool)
        self.null, self.doc_id = null, np.frombuffer(docs, "<i8", n)
        self.first = np.concatenate([[1], 1 + np.cumsum(np.frombuffer(docs, "<u4", n, 9 * n).astype(np.int64))])
        sizes = np.concatenate([[0], np.cumsum(self.table[:, 1])])
        self.start = sizes[self.first] // 4  # ids before each document in this file

    def _at(self, lo: int, n: int) -> bytes:
        self.stream.seek(lo)
        got = self.stream.read(n)
        if len(got) != n:
            raise Damaged("the file ends too early")
        return got

    def read(self, k: int) -> bytes:
        """Ids of the ``k``-th document, checked against its frames' checksums."""
        out, coder = [], zstandard.ZstdDecompressor()
        for f in range(int(self.first[k]), int(self.first[k + 1])):
            packed, size, check = self.table[f]
            try:
                raw = coder.decompress(self._at(int(self.offset[f]), int(packed)), max_output_size=int(size))
            except zstandard.ZstdError as e:
                raise Damaged(f"frame {f} of document {k}: {e}") from e
            if len(raw) != size or checksum(raw) != check:
                raise Damaged(f"frame {f} of document {k} fails its checksum")
            out.append(raw)
        return b"".join(out)

    def find(self, doc_id: int | None) -> list[int]:
        """Places of the documents of an id (ids ascend, nulls first)."""
        nulls = int(self.null.sum())
        if doc_id is None:
            return list(range(nulls))
        own = self.doc_id[nulls:]
        return list(range(nulls + int(np.searchsorted(own, doc_id, "left")), nulls + int(np.searchsorted(own, doc_id, "right"))))


# --------------------------------------------------------------------- encoder

def splitter() -> Callable[[str], list[str]]:
    """``SPLIT`` as a search of all words of a text. The standard library's
    patterns take a third of the time where a class has no character beyond the
    basic plane; texts with such characters go to the regex package."""
    import regex
    plane = "".join(map(chr, range(0x10000)))
    letter, digit, space = ("".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(rf"\p{{{kind}}}+", plane))
                            for kind in ("L", "N", "White_Space"))
    basic = re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    every = regex.compile(SPLIT).findall
    # UTF-16 has two bytes for each character of the basic plane, four for others
    return lambda text: basic(text) if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else every(text)


class Words(dict):
    """Ids of words by the library's model, which is asked when a word is not
    remembered. Words that come again stay: when one set of ``WORDS`` is full
    the next begins, and only those not seen since the last change are left
    behind. Words beyond ``LONGEST`` are never kept."""

    def __init__(self, tokenize: Callable) -> None:
        self.tokenize = tokenize
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():  # all but the space stand for themselves
                letters = word.replace(" ", self.letters[32])
            else:
                letters = word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordCoder:
    """The tokenizers library, asked once for a word that is remembered. A
    byte-level tokenizer cuts a text into words before anything else and its
    model encodes each by itself, so a word's ids are the same in every text.
    Texts that hold an added token's string, and all texts of tokenizers of
    another kind, are encoded whole."""

    def __init__(self, spec: str) -> None:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        form = json.loads(spec)
        pre = form.get("pre_tokenizer") or {}
        self.by_word = (not form.get("normalizer") and form["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel"
                        and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        self.added = [a["content"] for a in form.get("added_tokens", [])]
        self.cut = splitter()
        self.words = Words(self.tok.model.tokenize)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole = [k for k, t in enumerate(texts) if not self.by_word or any(a in t for a in self.added)]
        for k, e in zip(whole, self.tok.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        get = self.words.__getitem__
        for k in sorted(set(range(len(texts))).difference(whole)):
            out[k] = b"".join(map(get, self.cut(texts[k])))
        return out


@lru_cache(1)
def word_coder(spec: str) -> WordCoder:
    """One coder for all tasks of a Python worker: what one has learned, the
    next ones know."""
    return WordCoder(spec)


# ------------------------------------------------------------------------ Spark

def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """id, tie (order among equal ids), compressed frames, their sizes and
    checksums. The tokenizer's file (of fixed size) is broadcast."""
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = word_coder(held.value), zstandard.ZstdCompressor(level=LEVEL)
        for part in slices(batches, 1 << 20):
            done = [compress(ids + tail, coder=packer) for ids in coder.encode(texts_of(part))]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("tie"), pa.array([int(t[:, 1].sum(dtype=np.int64)) for _, t in done], pa.int64()),
                pa.array([b for b, _ in done], pa.binary()), pa.array([t.astype("<u4").tobytes() for _, t in done], pa.binary())], ["id", "tie", "size", "data", "frames"])

    rows = frame(docs, id_col, text_col).select("id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "id long, tie long, size long, data binary, frames binary")


def write_documents(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int | None = END_ID, most: int = FILE_BYTES) -> None:
    """Encode every text, append ``end_id`` and write the files of all documents
    in ascending id order into the new folder ``path``.

    Spark has no sink for raw bytes, so each file travels as one row through
    the text sink, one row a file; the sink's row separator supplies the file's
    last byte, which is the same in every file."""
    rows = stored(encoded(docs, tokenizer, id_col, text_col, end_id).withColumn("row", F.monotonically_increasing_id()), "frames")
    total = rows.agg(F.sum("size")).head()[0] or 0
    keys = ["id", "tie", "row"]
    dealt = rows.repartitionByRange(max(1, -(-total // most)), *keys).sortWithinPartitions(*keys)
    last = struct.pack("<I", SEEK_MAGIC)[-1:]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            whole = file_bytes(held, part, number)
            assert whole[-1:] == last
            body = pa.py_buffer(whole[:-1])
            cell = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(whole) - 1], "<i4").tobytes()), body])
            return pa.RecordBatch.from_arrays([cell], ["value"])

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for r in b.slice(lo, 64).to_pylist():
                    if held and size + r["size"] > most:
                        yield out()
                        number, held, size = number + 1, [], 0
                    held.append(Entry(r["id"], r["data"], np.frombuffer(r["frames"], "<u4").reshape(-1, 3)))
                    size += r["size"]
        if held:
            yield out()

    dealt.select("id", "size", "data", "frames").mapInArrow(build, "value string").write \
        .option("encoding", "ISO-8859-1").option("lineSep", last.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _starts(files: DataFrame) -> DataFrame:
    """part, number and the ids before each file, from the files' heads alone:
    running sums within groups of parts, then over the groups' totals."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [struct.unpack(HEAD, h) for h in b.column("head").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h[3] for h in got], pa.int64()), pa.array([h[4] for h in got], pa.int64()), pa.array([h[6] for h in got], pa.int64())],
                                             ["f_part", "f_number", "ids"])

    from pyspark.sql import Window
    rows = files.select(F.substring("content", 1, HEAD_SIZE).alias("head")).mapInArrow(heads, "f_part long, f_number long, ids long") \
        .withColumn("block", F.floor(F.col("f_part") / 1024))
    blocks = rows.groupBy("block").agg(F.sum("ids").alias("all"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("f_part", "f_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base_in", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return rows.join(blocks, F.col("block") == F.col("b")).select("f_part", "f_number", (F.col("base") + F.col("base_in")).alias("base"))


def read_documents(spark: SparkSession, path: str, wanted: list[int | None] | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    with ``keep_ids``, the ids, read back from the files of ``path``. With
    ``wanted`` (a list that the caller holds) only the frames of those
    documents are decompressed."""
    fields = [("part", pa.int64()), ("number", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "part long, number long, doc_id long, within long, n_tokens long, ids_crc32 long"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int64())))
        schema += ", ids array<long>"
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = SeekableReader(io.BytesIO(b.column("content")[i].as_buffer()))
                ks = range(r.documents) if wanted is None else sorted({k for w in wanted for k in r.find(w)})
                for lo in range(0, len(ks), 256):
                    rows = []
                    for k in ks[lo:lo + 256]:
                        raw = r.read(k)
                        rows.append((r.part, r.number, None if r.null[k] else int(r.doc_id[k]), int(r.start[k]), len(raw) // 4, zlib.crc32(raw),
                                     *([np.frombuffer(raw, "<u4").astype(np.int64)] if keep_ids else [])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    files = _files(spark, path)
    rows = files.select("content").mapInArrow(run, schema)
    starts = _starts(files)
    rows = rows.join(starts, (F.col("part") == F.col("f_part")) & (F.col("number") == F.col("f_number")))
    return rows.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def new_folder(spark: SparkSession) -> str:
    """A path for files in the shared folder, removed when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}-shards"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_and_read(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", most: int = FILE_BYTES) -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    path = new_folder(docs.sparkSession)
    write_documents(docs, path, tokenizer, id_col, text_col, most=most)
    return read_documents(docs.sparkSession, path).withColumnRenamed("doc_id", id_col)
