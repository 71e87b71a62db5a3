"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest length (nothing is
dropped), pieces are dealt into groups of bounded size by their hash, and each
group is packed on its own, longest piece first:

* a piece goes into the open bin that it leaves with the least room;
* when none has room, a bin is opened whose length has the least cost per
  token that the pieces still waiting can fill it with (all permitted lengths
  are tried together, each filled by a trial best fit from the waiting
  lengths);
* at the end every bin shrinks to the shortest permitted length that holds its
  contents.

A bin of length L costs ``L + overhead``. Groups grow in number, not in size,
with the input.

Defined results: null text counts as empty; every document has at least its
end token, so an empty one is a piece of one token; ties go to the bin opened
first; rows that repeat an id are packed each; a null id is packed like any
other; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, slices, stored, texts_of
from .words import words

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
PIECES_PER_GROUP = 20_000
TRIAL = LENGTHS[-1]  # pieces of a token that a bin can hold; bounds the plain scans of the tests, nothing here


def open_length(first: int, waiting: list[int], count: list[int], lengths: Sequence[int], overhead: float) -> int:
    """The permitted length with the least cost per token when a bin is opened
    for ``first``: a trial fill takes, again and again, the longest waiting
    piece (``waiting`` has the distinct sizes, ascending, and ``count`` how many
    wait of each) that still fits, until none does; equal pieces are taken at once."""
    best, best_cost = lengths[-1], float("inf")
    for length in lengths:
        if length < first:
            continue
        room, used, hi = length - first, first, len(waiting)
        while room and hi:
            hi = bisect_left(waiting, room + 1, 0, hi)
            if not hi:
                break
            hi -= 1
            taken = min(count[hi], room // waiting[hi]) * waiting[hi]
            room -= taken
            used += taken
        cost = (length + overhead) / used
        if cost < best_cost:
            best, best_cost = length, cost
    return best


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece (in the given order), and each bin's final
    length. Pieces must not exceed the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    waiting = sorted(set(sizes))
    number = Counter(sizes)
    count = [number[s] for s in waiting]
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    filled: list[int] = []
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        count[-1] -= 1  # the longest that waits
        if not count[-1]:
            waiting.pop()
            count.pop()
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b, free = len(filled), open_length(size, waiting, count, lengths, overhead)
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += size
        if free > size:
            insort(room, (free - size, b))
    return where, offset, [lengths[bisect_left(lengths, f)] for f in filled]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens: words ``[^\\x20\\x09-\\x0D]+`` of the whole text and one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(words(texts_of(part)).ptr) + 1, pa.int64())], ["id", "n_tokens"])

    return frame(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long").withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: float = OVERHEAD, id_col: str = "doc_id",
                   text_col: str = "text", pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """One row per piece: the id, piece (0, 1, ...), start (token of the
    document), n_tokens, group and bin (together the sequence), offset in the
    sequence, length of the sequence."""
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("permitted lengths must be positive")
    most = lengths[-1]
    counted = token_counts(docs, id_col, text_col).withColumnRenamed(id_col, "id")
    pieces = stored(counted.select("id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(most))).alias("piece", "start"))
                    .select("id", "piece", "start", F.least(F.col("n_tokens") - F.col("start"), F.lit(most)).alias("n_tokens")), "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        where, offset, length = pack(pdf["n_tokens"].tolist(), lengths, overhead)
        return pdf.assign(bin=where, offset=offset, length=np.asarray(length, np.int64)[where])[
            ["id", "piece", "start", "n_tokens", "group", "bin", "offset", "length"]]

    schema = "id long, piece int, start long, n_tokens long, group long, bin long, offset long, length long"
    return dealt.groupBy("group").applyInPandas(one, schema).withColumnRenamed("id", id_col)
