import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from swellcast.llm import repair
from swellcast.llm.common import read
from swellcast.llm.repair import Row

PATTERN = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Shortest path over (rows read, pattern state), by relaxing whole layers:
    the smallest (cost, audit) without any pruning."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    layer = {"": (0, "", ())}

    def put(to, key, label):
        if key not in to or label[:2] < to[key][:2]:
            to[key] = label
            return True
        return False

    def inserts(layer):
        todo = list(layer)
        while todo:
            s = todo.pop()
            for c, role in (("u", "user"), ("a", "assistant")):
                if (s, c) in step:
                    cost, audit, text = layer[s]
                    if put(layer, step[s, c], (cost + 2, audit + "I", (*text, role + ":"))):
                        todo.append(step[s, c])
        return layer

    for r in rows:
        layer, after = inserts(layer), {}
        for s, (cost, audit, text) in layer.items():
            put(after, s, (cost + 3, audit + "D", text))
            if not r.gone:
                if (s, r.role[:1]) in step:
                    put(after, step[s, r.role[:1]], (cost + r.cut, audit + "K", (*text, f"{r.role}:{r.text}")))
                for c, role in (("u", "user"), ("a", "assistant")):
                    if (s, c) in step:
                        put(after, step[s, c], (cost + r.cut + 2, audit + "R", (*text, f"{role}:{r.text}")))
        layer = after
    return min(v for s, v in inserts(layer).items() if s in ("", "a"))


def every_repair(rows, most_inserts=3):
    """All edit sequences of a few rows, tested against the pattern itself."""
    best = None
    for edits in itertools.product("KUAD", repeat=len(rows)):
        for gaps in itertools.product(range(most_inserts), repeat=len(rows) + 1):
            slots = sum(gaps)
            if slots > most_inserts:
                continue
            for new in itertools.product("ua", repeat=slots):
                new, cost, audit, roles = iter(new), 0, "", ""
                for i in range(len(rows) + 1):
                    for _ in range(gaps[i]):
                        cost, audit, roles = cost + 2, audit + "I", roles + next(new)
                    if i < len(rows):
                        r, e = rows[i], edits[i]
                        if e == "D":
                            cost, audit = cost + 3, audit + "D"
                        elif r.gone:
                            cost = 10**6
                        elif e == "K":
                            cost, audit, roles = cost + r.cut, audit + "K", roles + r.role[:1]
                        else:
                            cost, audit, roles = cost + 2 + r.cut, audit + "R", roles + e.lower()
                if cost < 10**6 and PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def some_rows(rnd, n):
    return [Row(rnd.choice(["user", "assistant", "system", "user", "assistant", "tool"]), f"t{i}", g := rnd.random() < 0.1, not g and rnd.random() < 0.2) for i in range(n)]


def test_search_equals_all_repairs():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(40 if n < 3 else 25):
            rows = some_rows(rnd, n)
            assert repair.search(rows) == cheapest(rows)[:2] == every_repair(rows), rows


def test_search_equals_the_layered_path():
    rnd = random.Random(2)
    for k in range(300):
        rows = some_rows(rnd, rnd.randrange(30))
        cost, audit, text = cheapest(rows)
        assert repair.search(rows) == (cost, audit)
        assert repair.solve(rows, 1 + k % 7) == (cost, audit)
        assert repair.repaired(rows, audit) == list(text)


def test_bounds_never_exceed_the_cost():
    rnd = random.Random(3)
    for _ in range(200):
        rows = some_rows(rnd, 8)
        assert repair.bounds(rows)[0][repair.START] <= cheapest(rows)[0]
        for s in repair.STATES:
            assert repair.bounds(rows)[0][s] <= repair.search(rows, s)[0]


def by_hand(rows):
    """Damage, faults and repair of (conv_id, turn, role, text) rows."""
    by = {}
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text, mine = sp(role), sp(text), by.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            judged.append(Row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, text = cheapest(judged)
        illegal = sum(a.role[:1] + b.role[:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def rows_of(df, **how):
    got = repair.repair_conversations(df, **how).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_whole_table(spark):
    conv = read(spark, SF_SMALL, "conversations")
    want = by_hand([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(conv) == want
    assert rows_of(conv, chunk=3, whole_rows=4) == want


SCHEMA = "conv_id long, turn long, role string, text string, part int, seq long, copies string, again string, digest string, cost string, first string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z", "c", "f") for r in rows], SCHEMA)


def test_awkward_rows(spark):
    rnd = random.Random(4)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 3, "assistant", None), (1, 3, None, "Yes!\n"),
            (2, 1, "tool", "x" * 300_000 + "."), (2, 2, "", "Ünï 漢字 🙂"), (3, 5, "system", " \t"), (4, -3, "assistant", "no end"), (4, 9, "assistant", "no end")]
    rows += [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Yes.", "No", "", f"Turn {t}."])) for t in range(400) for _ in range(2)]
    rows += [(8, 1, "user", "Again.")] * 300 + [(9, t, "assistant", f"{t}") for t in range(200)]
    everything_dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((everything_dropped, 1, "user", "Gone."))
    rnd.shuffle(rows)
    df, want = table(spark, rows), by_hand(rows)
    assert want[everything_dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert rows_of(df) == want
    assert rows_of(df.repartition(7), chunk=5, whole_rows=8) == want
    many = df.select(*(F.col(c).alias(c) for c in df.columns)).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(many, chunk=16, whole_rows=32) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table(spark):
    assert repair.repair_conversations(table(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1000, 4000])
def test_long_conversations_stay_cheap(n):
    rnd = random.Random(n)
    rows = some_rows(rnd, n)
    assert repair.solve(rows) == cheapest(rows)[:2]
