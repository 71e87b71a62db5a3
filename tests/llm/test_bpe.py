import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from swellcast.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n  x", "don't we'll I'M", "<|endoftext|>a<|endoftext|><|endoftext|>", "日本語 текст العربية 🙂🙂", "a" * 3000, "-" * 300, "\x00\x1c\x85\u2028 é", "=" * 70 + "    " * 30]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    coder, rnd = bpe.Encoder(bpe.Vocabulary.load(PATH)), random.Random(1)
    pool = list("abcdehilmnorstuvw   \t\n\x0b\x1c\x85\xa0\u200b\u3000éßñ漢字🙂'0123٣-=%!") + ["<|endoftext|>", "'ll", " the", "    ", "-" * 66, "ing", "Ã"]
    texts = [t or "" for t in ODD] + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for text, raw in zip(texts, coder.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, text
        assert coder.decode(raw) == library.decode(ids, skip_special_tokens=False)


def test_documents_equal_the_library(spark, library):
    rows = list(enumerate(ODD)) + [(3, ODD[3])]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, keep_ids=True)
    for r in got.collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    back = bpe.decode_ids(got.select("doc_id", "ids"), PATH).collect()
    assert all(r.text == (ODD[r.doc_id] or "") for r in back)


def test_decoding_broken_bytes(library):
    coder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    ids = library.encode("🙂é漢", add_special_tokens=False).ids
    for k in range(len(ids)):
        for part in (ids[k:], ids[:k], ids[k:k + 1]):
            assert coder.decode(np.array(part, "<u4").tobytes()) == library.decode(part, skip_special_tokens=False)
