import random

import pytest

from swellcast.llm import packing


def brute(sizes, lengths, overhead):
    """The same rules by plain scans over all open bins and waiting pieces."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, where, offset = [], {}, {}
    for k, i in enumerate(order):
        fits = [(b["room"], n) for n, b in enumerate(bins) if b["room"] >= sizes[i]]
        if fits:
            n = min(fits)[1]
        else:
            waiting = sorted(sizes[j] for j in order[k + 1:])
            cost = []
            for length in lengths:
                if length < sizes[i]:
                    continue
                room, used, left = length - sizes[i], sizes[i], list(waiting)
                for _ in range(packing.TRIAL):
                    ok = [x for x in left if x <= room]
                    if not ok:
                        break
                    room, used, left = room - ok[-1], used + ok[-1], ok[:-1]
                cost.append(((length + overhead) / used, length))
            bins.append({"room": min(cost)[1], "used": 0})
            n = len(bins) - 1
        where[i], offset[i] = n, bins[n]["used"]
        bins[n]["used"] += sizes[i]
        bins[n]["room"] -= sizes[i]
    return [where[i] for i in range(len(sizes))], [offset[i] for i in range(len(sizes))], [min(x for x in lengths if x >= b["used"]) for b in bins]


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_scans(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 30), rnd.randint(1, 256), 64, 1]) for _ in range(250)]
    assert packing.pack(sizes, (32, 64, 128, 256), 4) == brute(sizes, (32, 64, 128, 256), 4)


def test_every_token_is_packed_once(spark):
    rows = [(i, " ".join(["w"] * n)) for i, n in enumerate([0, 1, 7, 8, 9, 15, 16, 17, 40, 100, 3, 3, 3])] + [(99, None), (None, "a b")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), (4, 8, 16), 2, pieces_per_group=5).toPandas()
    want = {i: len((t or "").split()) + 1 for i, t in rows}
    for i, n in want.items():
        own = got[got["doc_id"].isna()] if i is None else got[got["doc_id"] == i]
        own = own.sort_values("piece")
        assert own["n_tokens"].sum() == n and own["start"].tolist() == [16 * k for k in range(len(own))]
    for _, b in got.sort_values("offset").groupby(["group", "bin"]):
        assert b["offset"].tolist() == [0, *b["n_tokens"].cumsum().tolist()[:-1]]
        used = b["n_tokens"].sum()
        assert set(b["length"]) == {min(x for x in (4, 8, 16) if x >= used)}


def test_lengths_must_be_positive(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ())


def test_a_long_bin_of_many_short_pieces():
    """4096 + 16 for 512 pieces of 8 tokens is the least cost a token."""
    where, _, length = packing.pack([8] * 5_000)
    assert length[:9] == [4096] * 9 and sum(x + 16 for x in length) / 40_000 < 1.02  # bins of 512 only: 1.043
    assert [where.count(b) for b in range(9)] == [512] * 9


@pytest.mark.parametrize("seed", range(3))
def test_trial_fill_runs_to_its_end(seed):
    rnd = random.Random(seed)
    waiting = sorted(rnd.choice([1, 2, 3, 8, rnd.randint(1, 40)]) for _ in range(rnd.choice([90, 900, 2_500])))
    first, cost = waiting[-1], []
    for length in packing.LENGTHS:
        room, left = length - first, list(waiting)
        while any(x <= room for x in left):
            at = max(k for k, x in enumerate(left) if x <= room)
            room -= left.pop(at)
        cost.append(((length + 16) / (length - room), length))
    distinct = sorted(set(waiting))
    assert packing.open_length(first, distinct, [waiting.count(x) for x in distinct], packing.LENGTHS, 16) == min(cost)[1]
