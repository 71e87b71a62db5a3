"""Language identification with a linear-chain conditional random field.

Every word of a text gets a language label. A word's features are its byte
n-grams (1 to 5, those at its ends being its affixes) and its own identity in
a lexicon of frequent sample words; neighbouring labels are tied by learned
transition weights. Forward-backward gives each word's label probabilities, so
code-switched text is labelled word by word; a document's language is the one
with the largest mean probability.

Training reads at most about ``docs_per_language`` labelled documents of each
language (a hash sample; one span of ``SPAN`` words each), and half of the
training sequences join spans of two documents, which is how the transitions
between languages are learned. Prediction reads whole texts and nothing else.

Defined results: null or letterless text is ``und`` with score 0; without any
labelled document every text is ``und``; words without letters take part in
the chain but not in a document's mean; repeated rows get equal results;
other columns are never read in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, texts_of
from .words import U, Words, hash_spans, mix, words

DOCS_PER_LANGUAGE = 400
SPAN = 40  # words of a training span
TABLE = 1 << 17  # hashed features
LEXICON = 20_000  # frequent sample words that are features themselves
NGRAMS = 5
EPOCHS, BATCH, RATE = 6, 64, 0.1
CONFIDENT = 0.8  # a word whose label is this probable is recognised
UNDETERMINED = "und"


@dataclass
class Model:
    labels: list[str]
    weight: np.ndarray  # (TABLE, K)
    step: np.ndarray  # (K, K): from, to
    first: np.ndarray  # (K,)
    lexicon: np.ndarray  # sorted word hashes


def features(w: Words, pick: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, owners) of the words ``pick``; an owner is a position in ``pick``."""
    size = w.end[pick] - w.start[pick]
    # the words side by side, each between two spaces
    width = size + 2
    at = np.concatenate([[0], np.cumsum(width)])
    buf = np.full(at[-1] + 8, 32, np.uint8)
    owner = np.repeat(np.arange(len(pick)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    buf[at[owner] + 1 + inside] = w.buf[w.start[pick][owner] + inside]
    lanes = np.ndarray((at[-1],), "<u8", buf, strides=(1,))
    every = np.repeat(np.arange(len(pick)), width)
    left = at[every + 1] - np.arange(at[-1])  # bytes to the end of the word's field
    ids, owners = [], []
    for n in range(1, NGRAMS + 1):
        ok = left >= n
        if n == 1:
            ok &= buf[:at[-1]] != 32
        x = lanes[ok] & U((1 << (8 * n)) - 1)
        ids.append((mix(x + U(n << 56)) % U(TABLE)).astype(np.int64))
        owners.append(every[ok])
    h = hash_spans(w.buf, w.start[pick], w.end[pick])
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
        ids.append((mix(h[known] ^ U(0x1EC51C02)) % U(TABLE)).astype(np.int64))
        owners.append(np.flatnonzero(known))
    return np.concatenate(ids), np.concatenate(owners)


def emissions(ids: np.ndarray, owners: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    out = np.empty((n, weight.shape[1]), np.float32)
    for k in range(weight.shape[1]):
        out[:, k] = np.bincount(owners, weight[ids, k], n)
    return out


def marginals(score: np.ndarray, ptr: np.ndarray, step: np.ndarray, first: np.ndarray, forward: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over many chains at once, one vector step per word
    position; chains are sorted by length, so the active ones are a prefix.
    ``forward`` receives the normalised forward probabilities."""
    out = np.empty_like(score)
    length = np.diff(ptr)
    order = np.argsort(-length, kind="stable")
    begin, length = ptr[:-1][order], length[order]
    if not len(length) or not length[0]:
        return out
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), "right")
    local = np.exp(score - score.max(1, keepdims=True)) + np.float32(1e-12)
    move = np.exp(step - step.max()).astype(np.float32)
    a = local[begin[:active[0]]] * np.exp(first - first.max()).astype(np.float32)
    a /= a.sum(1, keepdims=True)
    out[begin[:active[0]]] = a
    for t in range(1, length[0]):
        at = begin[:active[t]] + t
        a = (a[:active[t]] @ move) * local[at]
        a /= a.sum(1, keepdims=True)
        out[at] = a
    if forward is not None:
        forward[:] = out
    k = score.shape[1]
    b = np.ones((active[-1], k), np.float32)
    for t in range(length[0] - 1, -1, -1):
        at = begin[:active[t]] + t
        if len(b) < len(at):
            b = np.concatenate([b, np.ones((len(at) - len(b), k), np.float32)])
        g = out[at] * b
        out[at] = g / g.sum(1, keepdims=True)
        b = (local[at] * b) @ move.T
        b /= b.sum(1, keepdims=True)
    return out


def fit(spans: list[tuple[str, str]], seed: int = 7) -> Model:
    """Train on (language, span text) pairs by AdaGrad on the exact CRF gradient."""
    spans = sorted(spans)
    labels = sorted({lang for lang, _ in spans})
    k = len(labels)
    w = words([t.lower() for _, t in spans])
    h = w.hashes()
    known, count = np.unique(h, return_counts=True)
    lexicon = np.sort(known[np.argsort(-count, kind="stable")][:LEXICON][np.sort(-count, kind="stable")[:LEXICON] <= -2])
    label = np.array([labels.index(lang) for lang, _ in spans])
    weight, step, first = np.zeros((TABLE, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    g_weight, g_step, g_first = np.full((TABLE, k), 1e-4, np.float32), np.full((k, k), 1e-4, np.float32), np.full(k, 1e-4, np.float32)
    rng = np.random.default_rng(seed)
    n = len(spans)
    for epoch in range(EPOCHS if k > 1 else 0):
        partner = rng.permutation(n)
        joined = rng.random(n) < 0.5
        for batch in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            pick, truth, size = [], [], []
            for i in batch:
                own = np.arange(w.ptr[i], w.ptr[i + 1])
                if joined[i]:
                    other = np.arange(w.ptr[partner[i]], w.ptr[partner[i] + 1])
                    own, other = own[:max(1, len(own) // 2)], other[len(other) // 2:]
                    pick += [own, other]
                    truth += [np.full(len(own), label[i]), np.full(len(other), label[partner[i]])]
                    size.append(len(own) + len(other))
                else:
                    pick.append(own)
                    truth.append(np.full(len(own), label[i]))
                    size.append(len(own))
            pick, truth, ptr = np.concatenate(pick), np.concatenate(truth), np.concatenate([[0], np.cumsum(size)])
            if not len(pick):
                continue
            ids, owners = features(w, pick, lexicon)
            score = emissions(ids, owners, len(pick), weight)
            ahead = np.empty_like(score)
            p = marginals(score, ptr, step, first, ahead)
            gap = p.copy()
            gap[np.arange(len(pick)), truth] -= 1
            inner = np.ones(len(pick), bool)
            inner[ptr[:-1][np.diff(ptr) > 0]] = False
            prev = np.flatnonzero(inner) - 1
            # p(y_t, y_t+1) = forward(y_t) move(y_t, y_t+1) p(y_t+1) / sum over y_t of forward(y_t) move(y_t, y_t+1)
            move = np.exp(step - step.max())
            pair = ahead[prev][:, :, None] * move[None] * (p[prev + 1] / np.maximum(ahead[prev] @ move, 1e-30))[:, None, :]
            d_step = pair.sum(0)
            np.add.at(d_step, (truth[prev], truth[prev + 1]), -1)
            d_step = (d_step / len(batch)).astype(np.float32)
            d_first = (gap[ptr[:-1][np.diff(ptr) > 0]].sum(0) / len(batch)).astype(np.float32)
            hit = np.unique(ids)
            slot = np.searchsorted(hit, ids)
            d = np.stack([np.bincount(slot, gap[owners, j], len(hit)) for j in range(k)], 1).astype(np.float32) / len(batch)
            g_weight[hit] += d * d
            weight[hit] -= RATE * d / np.sqrt(g_weight[hit])
            g_step += d_step * d_step
            step -= RATE * d_step / np.sqrt(g_step)
            g_first += d_first * d_first
            first -= RATE * d_first / np.sqrt(g_first)
    return Model(labels, weight, step, first, lexicon)


def label_words(texts: list[str], model: Model) -> tuple[Words, np.ndarray]:
    """The words of the (lower-cased) texts and their label probabilities."""
    w = words([t.lower() for t in texts])
    h = w.hashes()
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    if not len(one):
        return w, np.zeros((0, len(model.labels)), np.float32)
    ids, owners = features(w, one, model.lexicon)
    return w, marginals(emissions(ids, owners, len(one), model.weight)[back], w.ptr, model.step, model.first)


def judged(texts: list[str], model: Model) -> list[tuple[str, float, float]]:
    """Language, its mean probability, and the share of the words that are
    recognised, each in whatever language."""
    if not model.labels:
        return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
    w, p = label_words(texts, model)
    # bytes of letters: ASCII letters or any non-ASCII byte stand for a worded token
    buf = w.buf
    letter = ((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 128)
    total = np.concatenate([[0], np.cumsum(letter)])
    worded = (total[w.end] - total[w.start]) > 0
    out = []
    for i, text in enumerate(texts):
        if not any(map(str.isalpha, text)):
            out.append((UNDETERMINED, 0.0, 0.0))
            continue
        own = slice(w.ptr[i], w.ptr[i + 1])
        each = p[own][worded[own]] if worded[own].any() else p[own]
        mean = each.mean(0, dtype=np.float64)
        best = int(mean.argmax())
        out.append((model.labels[best], float(min(1.0, mean[best])), float((each.max(1) >= CONFIDENT).mean())))
    return out


def predict(texts: list[str], model: Model) -> list[tuple[str, float]]:
    return [(lang, score) for lang, score, _ in judged(texts, model)]


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fit on a hash sample of the ``usable`` rows that have a label."""
    known = docs.where(usable & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col].cast("string")).alias("h"))
    counts = known.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return Model([], *(np.zeros(0, np.float32) for _ in range(3)), np.zeros(0, U))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, docs_per_language / r["count"])))])
    parts = F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != "")
    rows = (known.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", parts.alias("w"), "h")
            .where(F.size("w") > 0)
            .select("lang", F.array_join(F.slice("w", (F.pmod(F.shiftright("h", 20), F.size("w")) + 1).cast("int"), SPAN), " ").alias("span"))
            .collect())  # about docs_per_language short spans per language
    return fit([(r["lang"], r["span"]) for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every document. The model (fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = predict(texts_of(part), shared.value)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    return frame(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is found with at least
    ``min_score``, or of whose words at least that share is recognised: a text
    in several languages has no language of a high mean."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, col=text_col):
            found = judged(texts_of(part, text_col), shared.value)
            yield part.filter(pa.array([lang != UNDETERMINED and max(score, known) >= min_score for lang, score, known in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
