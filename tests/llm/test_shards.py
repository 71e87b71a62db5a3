import glob
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from conftest import SF_SMALL
from swellcast.llm import shards
from swellcast.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id long, tie string, row string, size string, data string, frames string, start string, n_tokens string, part string"


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(PATH)


def by_hand(coder, rows):
    """(doc_id, start, n_tokens, crc32) in ascending doc_id order."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("most", [shards.FILE_BYTES, 20_000])
def test_whole_table(spark, coder, most):
    docs = read(spark, SF_SMALL, "documents")
    want = by_hand(coder, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(shards.write_and_read(docs, PATH, most=most)) == want


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, *["x"] * 8) for r in rows], SCHEMA)


def test_awkward_rows(spark, coder):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(None, "null id"), (None, None), (3, ""), (1, None), (2, "<|endoftext|> ünï 漢字 🙂\x00"), (9, long), (9, long), (-4, "minus"), (1 << 60, " \n\t"), *[(5, "hot row")] * 400]
    out = got(shards.write_and_read(table(spark, rows).repartition(5), PATH, most=2_000))
    want = by_hand(coder, rows)
    assert [r[0] for r in out] == [r[0] for r in want] and sum(r[2] for r in out) == sum(r[2] for r in want)
    assert sorted((repr(r[0]), r[2], r[3]) for r in out) == sorted((repr(r[0]), r[2], r[3]) for r in want)
    assert [r[1] for r in out] == list(np.cumsum([0] + [r[2] for r in out])[:-1])


def test_empty_table(spark):
    assert got(shards.write_and_read(table(spark, []), PATH)) == []


def test_readers_decompress_only_what_is_asked_for(spark, coder):
    docs = table(spark, [(i, f"document number {i} " * (i + 1)) for i in range(50)])
    path = shards.new_folder(spark)
    shards.write_documents(docs, path, PATH, most=3_000)
    local = path.removeprefix("file:")
    files = sorted(glob.glob(f"{local}/part-*"))
    assert len(files) > 3
    # an ordinary zstandard reader finds the ids of all documents in order
    ids = [i for d in range(50) for i in coder.encode(f"document number {d} " * (d + 1), add_special_tokens=False).ids + [0]]
    whole = {}
    for f in files:
        raw = open(f, "rb").read()
        r = shards.SeekableReader(io.BytesIO(raw))
        whole[r.part, r.number] = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert b"".join(whole[k] for k in sorted(whole)) == np.array(ids, "<u4").tobytes()
    some = shards.read_documents(spark, path, wanted=[7, 31, 777], keep_ids=True).collect()
    assert {r.doc_id: r.ids for r in some} == {d: coder.encode(f"document number {d} " * (d + 1), add_special_tokens=False).ids + [0] for d in (7, 31)}


def test_words_encode_as_whole_texts_do(coder):
    import random
    rnd = random.Random(3)
    pieces = ["the", " The", "naïve", " 漢字", "🙂", "'s", "'ll", "I'm", "  ", "\n", "\t ", "\u00a0", "\u2003", "\x85", "12", " 3.5", "--", "<|endoftext|>", "e\u0301", "\x00", "ſ", "'S", " '", "x" * 40]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["", " ", "a" * 5000]
    mine = shards.WordCoder(open(PATH, encoding="utf-8").read())
    assert mine.by_word
    for lo in range(0, len(texts), 100):
        assert mine.encode(texts[lo:lo + 100]) == [np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[lo:lo + 100]]
    other = shards.WordCoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_word and other.encode(texts[:50]) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[:50]]


def test_splitter_cuts_as_the_pattern_does():
    import random
    import regex
    cut, want = shards.splitter(), regex.compile(shards.SPLIT).findall
    rnd = random.Random(7)
    kinds = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for between in ("", " ", "  ", "a", "1", "'", "'s", "\n"):
        text = between.join(kinds)
        assert cut(text) == want(text)
    some = ["a", "É", "漢", "7", "½", "_", "'", "'s", "'ll", "'RE", " ", " ", "  ", "\x1c", "\x85", "\u00a0", "\u3000", "\n", "\t", "e\u0301", "\x00", "🙂", "𝒜", "𝟙"]
    for _ in range(20_000):
        text = "".join(rnd.choices(some, k=rnd.randrange(12)))
        assert cut(text) == want(text)


def test_a_word_that_comes_again_is_asked_for_once(coder, monkeypatch):
    """Also by the next task of a worker, and beyond the words that are remembered."""
    spec = open(PATH, encoding="utf-8").read()
    mine = shards.word_coder(spec)
    assert shards.word_coder(spec) is mine
    monkeypatch.setattr(shards, "WORDS", 50)
    asked = []
    words = shards.Words(lambda letters: asked.append(letters) or coder.model.tokenize(letters))
    monkeypatch.setattr(mine, "words", words)
    long = "y" * 3000
    for k in range(400):
        text = f"often naïve v{k:03}x" if k % 100 else f"often naïve {long}"
        assert mine.encode([text]) == [np.array(coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(words) <= 50 and len(words.older) <= 50
    assert asked.count("often") == 1 and asked.count("ĠnaÃ¯ve") == 1  # in spite of 400 words between
    assert all(len(w) <= shards.LONGEST for w in [*words, *words.older])


def damaged_file():
    entries = [shards.Entry(i, *shards.compress(np.arange(i * 50, i * 50 + 50, dtype="<u4").tobytes(), 80)) for i in range(6)]
    return entries, shards.file_bytes(entries, 0, 0)


def test_damage_is_found_where_it_is():
    entries, good = damaged_file()
    r = shards.SeekableReader(io.BytesIO(good))
    assert [r.read(k) for k in range(6)] == [np.arange(k * 50, k * 50 + 50, dtype="<u4").tobytes() for k in range(6)]
    assert r.find(4) == [4] and r.find(6) == [] and r.find(None) == []
    hit = int(r.offset[r.first[2]]) + 12
    bad = bytearray(good)
    bad[hit] ^= 0x5A
    r = shards.SeekableReader(io.BytesIO(bytes(bad)))
    assert r.read(1) and r.read(3)  # other documents are not touched
    with pytest.raises(shards.Damaged):
        r.read(2)
    for cut in (good[:-1], good[:40], good[:-9] + b"x" * 9, good[10:]):
        with pytest.raises(shards.Damaged):
            shards.SeekableReader(io.BytesIO(cut))


def test_stream_is_read_by_ranges():
    _, good = damaged_file()

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counting.taken += n
            return super().read(n)

    shards.SeekableReader(Counting(good))
    tables = Counting.taken
    shards.SeekableReader(Counting(good)).read(5)
    assert Counting.taken - 2 * tables < 400
