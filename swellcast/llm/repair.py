"""Conversation structure repair: the cheapest edits that give a conversation
the role pattern ``(s?(ua)+)?``, found by depth-first branch-and-bound.

The search keeps an explicit stack of prefixes. A prefix at node (row, state)
is cut when the node's dominance table holds one that costs no more and reads
no later, or when its cost plus the suffix's lower bound exceeds the incumbent
(cost, audit). The bound counts the edits that no repair can avoid: rows that
must go, truncated rows, unknown roles, and disjoint neighbours whose roles
clash. Equal costs mean equal letter counts, so of two such audits at a node
neither is a prefix of the other, and the ASCII-least prefix stays least
whatever follows; for the same reason searches of consecutive chunks compose.

On Spark the rows are dealt and sorted by (conversation, turn, role, text)
ranges, so a conversation of any length is spread over tasks as consecutive
chunks. A task answers the conversations that lie wholly within it; for the
others it searches each chunk from every state to every state, a second pass
over these small tables (16 entries per chunk) picks the cheapest path, and a
third joins the chosen audits to the chunks' texts and hashes them in order,
one chunk in memory at a time.

Defined results: null conv_id, turn, role and text count as one space wherever
they are read (a null conv_id is still returned as null, and null turns come
first and count neither for gaps nor for distinct turns); rows of one turn that
differ are taken in order of (role, text); repeated rows are duplicates of the
first; roles with another initial than s, u or a can only be re-roled or
deleted; conversations without rows after damage get zeros, an empty audit and
the hash of the empty string; an empty table gives no rows; other columns are
never read. Texts and conversations may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# costs of the edits, fixed by the contract
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"

# states of the role pattern: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
DONE = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # inserts that complete the pattern
NEEDED = ("u", "u", "a", "u")
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}

CHUNK = 64  # rows of one search
WHOLE_ROWS, WHOLE_BYTES = 2048, 4 << 20  # a task answers conversations up to this size by itself


def fits(state: int, initial: str) -> bool:
    return initial == NEEDED[state] or (state == START and initial == "s")


@dataclass
class Row:
    role: str
    text: str
    gone: bool = False  # blank or duplicate: must be deleted
    cut: bool = False  # truncated

    @property
    def initial(self) -> str:
        return self.role[:1]


# ---------------------------------------------------------------------- search

def bounds(rows: list[Row]) -> list[list[int]]:
    """Lower bound on the cost of rows ``i`` and after, by row and state: forced
    costs, plus 2 for each of the most disjoint pairs of surviving neighbours
    (the state counting as the first one's left neighbour) that clash."""
    n = len(rows)
    out = [[0] * 4 for _ in range(n + 1)]
    forced, free, after, head = 0, 0, 0, ""  # free, after: clashes from the first / second survivor on
    for i in range(n - 1, -1, -1):
        r = rows[i]
        if r.gone:
            forced += DELETE
        else:
            known = r.initial in AFTER
            forced += TRUNCATED * r.cut + (0 if known else RENAME)
            c = r.initial if known else ""
            clash = head and c and c + head not in LEGAL_PAIRS
            free, after, head = max(free, after + RENAME if clash else 0), free, c
        for s in STATES:
            out[i][s] = forced + (max(free, after + RENAME) if head and not fits(s, head) else free)
    return out


def search(rows: list[Row], entry: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cheapest (cost, audit) that leads from ``entry`` over all rows to the
    state ``goal`` - without one, to a complete pattern, inserts at the end
    included. Ties go to the ASCII-least audit; None if the goal is out of reach."""
    n, low = len(rows), bounds(rows)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        node, label = (i, state), (cost, audit)
        if best is not None:
            least = cost + low[i][state]
            if least > best[0] or (least == best[0] and audit > best[1][:len(audit)]):
                continue
        if node in seen and seen[node] <= label:
            continue
        seen[node] = label
        if i == n and (state == goal if goal is not None else not DONE[state]):
            if best is None or label < best:
                best = label
        if i == n and goal is not None:
            continue  # what is inserted here belongs to the next chunk
        moves = [(i, AFTER[NEEDED[state]], cost + INSERT, audit + "I")]
        if i < n:
            r = rows[i]
            moves.append((i + 1, state, cost + DELETE, audit + "D"))
            if not r.gone:
                keep = cost + TRUNCATED * r.cut
                if fits(state, r.initial):
                    moves.append((i + 1, AFTER[r.initial], keep, audit + "K"))
                if r.initial != NEEDED[state]:
                    moves.append((i + 1, AFTER[NEEDED[state]], keep + RENAME, audit + "R"))
        moves.sort(key=lambda m: (-m[2] - low[m[0]][m[1]], [-ord(c) for c in m[3][-1:]]))
        stack.extend(moves)  # the most promising is popped first
    return best


Label = tuple[int, str]


def table(rows: list[Row]) -> list[list[Label | None]]:
    """Best (cost, audit) of one chunk from each state to each state."""
    return [[search(rows, a, b) for b in STATES] for a in STATES]


def extend(labels: dict[int, Label], step: list[list[Label | None]]) -> tuple[dict[int, Label], dict[int, int]]:
    """Follow one chunk: best label of each state after it, and from which
    state before it that came."""
    out: dict[int, Label] = {}
    back: dict[int, int] = {}
    for a, (cost, audit) in labels.items():
        for b in STATES:
            if (m := step[a][b]) is not None and (b not in out or (cost + m[0], audit + m[1]) < out[b]):
                out[b], back[b] = (cost + m[0], audit + m[1]), a
    return out, back


def finish(labels: dict[int, Label]) -> tuple[int, int, str]:
    """State, cost and audit (inserts at the end included) of the best complete repair."""
    return min(((s, c + INSERT * len(DONE[s]), a + DONE[s]) for s, (c, a) in labels.items()), key=lambda x: x[1:])


def solve(rows: list[Row], chunk: int = CHUNK) -> tuple[int, str]:
    if len(rows) <= chunk:
        return search(rows)
    labels = {START: (0, "")}
    for lo in range(0, len(rows), chunk):
        labels, _ = extend(labels, table(rows[lo:lo + chunk]))
    return finish(labels)[1:]


def repaired(rows: Iterator[Row] | list[Row], audit: str, state: int = START) -> list[str]:
    """The ``role:text`` lines that an audit leaves."""
    out, rows = [], iter(rows)
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        r = Row("", "") if edit == "I" else next(rows)
        initial = r.initial if edit == "K" else NEEDED[state]
        out.append(f"{r.role if edit == 'K' else NAMES[initial]}:{r.text}")
        state = AFTER[initial]
    return out


# ------------------------------------------------------------------------ rows

def damaged(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of copies (0: dropped, its
    conversation is still known), equal rows merged before the shuffle."""
    c = lambda name: F.coalesce(conv[name].cast("string"), F.lit(" "))
    code = F.crc32(F.concat(c("conv_id"), F.lit(":"), c("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(c("text"), ".!?", "")).otherwise(c("text"))
    rows = conv.select(conv["conv_id"].alias("conv_id"), F.when(code != 0, conv["turn"].cast("long")).alias("turn"),
                       F.when(code == 0, "").when(code == 4, "user").otherwise(c("role")).alias("role"),
                       F.when(code == 0, "").otherwise(text).alias("text"),
                       F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
                       (code == 0).alias("dropped"))
    return rows.groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.sum("copies").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Add ``again``: role and text were seen in an earlier turn. The first turn
    of each is a grouped minimum with map-side merging, and only texts with
    several turns are joined back."""
    keyed = stored(rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), "turns")
    live = keyed.where("NOT dropped")
    first = stored(live.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1").select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first"), "first")
    same = keyed["conv_id"].eqNullSafe(first["f_conv"]) & (keyed["role"] == first["f_role"]) & (keyed["digest"] == first["f_digest"])
    again = first["first"].isNotNull() & ~(F.struct(keyed["turn"].isNotNull(), keyed["turn"]).eqNullSafe(first["first"]))
    return keyed.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", (again & ~keyed["dropped"]).alias("again"))


@dataclass
class Tally:
    """Counts over consecutive rows, and what is needed to add the next ones."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, row: Row, blank: bool) -> None:
        self.blank += blank
        self.duplicate += row.gone and not blank
        self.truncated += row.cut
        if self.last is None:
            self.first = row.initial
        else:
            self.illegal += self.last + row.initial not in LEGAL_PAIRS
        self.last = row.initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def join(self, o: "Tally") -> "Tally":
        return Tally(self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
                     self.illegal + o.illegal + (self.last is not None and o.first is not None and self.last + o.first not in LEGAL_PAIRS),
                     o.low if self.low is None else self.low, self.high if o.high is None else o.high,
                     self.turns + o.turns - (self.high is not None and self.high == o.low),
                     o.first if self.first is None else self.first, self.last if o.last is None else o.last)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def read_row(role: str, text: str, seen: bool) -> tuple[Row, bool]:
    """The row with its first fault, and whether that is blankness."""
    body = text.rstrip(SPACE)
    blank = not body
    gone = blank or seen
    return Row(role, text, gone, not gone and body[-1] not in ".!?"), blank


Item = tuple[int | None, Row, bool]  # turn, row, blank


def tally(items: list[Item]) -> Tally:
    out = Tally()
    for item in items:
        out.add(*item)
    return out


@dataclass
class Open:
    """The conversation that a task is reading, and its rows not yet written."""

    conv: object
    partial: bool  # goes on in another task, or is too large for one search
    items: list[Item] = field(default_factory=list)
    size: int = 0
    written: bool = False


ANSWER = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ["blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
CHUNKS = ("gaps long, cost long, audit string, repaired_sha256 string, part int, seq long, "
          "costs array<long>, audits array<string>, roles array<string>, texts array<string>")


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _stream(rows: Iterator[tuple], part: int, chunk: int, whole_rows: int) -> Iterator[dict]:
    """Answers of the conversations that lie within a task's sorted rows, and
    searched chunks of the others."""
    seq = 0

    def write(o: Open, most: int) -> Iterator[dict]:
        nonlocal seq
        while len(o.items) >= most or (o.items and o.size > WHOLE_BYTES) or not o.written:
            items, o.items = o.items[:chunk], o.items[chunk:]
            o.size = sum(len(r.text) for _, r, _ in o.items)
            mine = [r for _, r, _ in items]
            steps = [x for line in table(mine) for x in line]
            yield {"conv_id": o.conv, **vars(tally(items)), "part": part, "seq": seq,
                   "costs": [None if x is None else x[0] for x in steps], "audits": [None if x is None else x[1] for x in steps],
                   "roles": [r.role for r in mine], "texts": ["" if r.gone else r.text for r in mine]}
            seq, o.written = seq + 1, True

    def close(o: Open) -> Iterator[dict]:
        if o.partial:
            yield from write(o, 1)
            return
        mine, counts = [r for _, r, _ in o.items], tally(o.items)
        cost, audit = solve(mine, chunk)
        yield {"conv_id": o.conv, **vars(counts), "gaps": counts.gaps, "cost": cost, "audit": audit, "repaired_sha256": sha(repaired(mine, audit))}

    now: Open | None = None
    for conv, turn, role, text, copies, again in rows:
        if now is None or conv != now.conv:
            if now is not None:
                yield from close(now)
            now = Open(conv, partial=now is None)  # the first one may have begun in the task before
        for k in range(copies):
            row, blank = read_row(role, text, again or k > 0)
            now.items.append((turn, row, blank))
            now.size += len(text)
            now.partial |= len(now.items) > whole_rows or now.size > WHOLE_BYTES
            if now.partial and (len(now.items) >= chunk or now.size > WHOLE_BYTES):
                yield from write(now, chunk)
    if now is not None:
        now.partial = True  # and the last one may go on in the next
        yield from close(now)


def _picked(rows: Iterator[tuple]) -> Iterator[dict]:
    """The cheapest path through the chunks of each conversation, in order:
    state before and after each chunk, totals on the last."""
    conv, chunks, labels, total = None, [], None, Tally()

    def close() -> Iterator[dict]:
        state, cost, _ = finish(labels)
        path = []
        for part, seq, back in reversed(chunks):
            path.append((part, seq, back[state], state))
            state = back[state]
        path.reverse()
        for k, (part, seq, a, b) in enumerate(path):
            last = k == len(path) - 1
            yield {"k_part": part, "k_seq": seq, "entry": a, "exit": b,
                   **({"gaps": total.gaps, "blank": total.blank, "duplicate": total.duplicate, "truncated": total.truncated, "illegal": total.illegal, "cost": cost} if last else {})}

    for row in rows:
        if labels is None or row["conv_id"] != conv:
            if labels is not None:
                yield from close()
            conv, chunks, labels, total = row["conv_id"], [], {START: (0, "")}, Tally()
        total = total.join(Tally(**{c: row[c] for c in COUNTS}, first=row["first"], last=row["last"]))
        step = [[None if c is None else (c, a) for c, a in zip(row["costs"][4 * i:4 * i + 4], row["audits"][4 * i:4 * i + 4])] for i in STATES]
        labels, back = extend(labels, step)
        chunks.append((row["part"], row["seq"], back))
        audits = [a for _, a in labels.values()]
        shared = next((i for i, cs in enumerate(zip(*audits)) if len(set(cs)) > 1), min(map(len, audits)))
        labels = {s: (c, a[shared:]) for s, (c, a) in labels.items()}  # what all share can decide nothing any more
    if labels is not None:
        yield from close()


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """Results of the conversations whose repaired chunks come in order."""
    now = None
    for r in rows:
        if now is None or r["conv_id"] != now["conv_id"]:
            if now is not None:
                yield now
            now = {"conv_id": r["conv_id"], "audit": [], "hash": hashlib.sha256(), "lines": 0}
        now["audit"].append(r["audit"])
        if r["lines"]:
            now["hash"].update(("\n" if now["lines"] else "").encode() + r["body"])
            now["lines"] += r["lines"]
        if r["cost"] is not None:
            now |= {c: r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    if now is not None:
        yield now


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            yield from b.slice(lo, 256).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def repair_conversations(conv: DataFrame, chunk: int = CHUNK, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """One row per conversation of ``conv`` (conv_id, turn, role, text) as it is
    after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    conv_type = conv.schema["conv_id"].dataType.simpleString()
    prefix = lambda c, n: F.substring(c, 1, n)
    dealt = marked(damaged(conv)).repartitionByRange(F.col("conv_id"), F.col("turn"), prefix("role", 16), prefix("text", 64))
    rows = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    counts = ", ".join(f"{c} long" for c in COUNTS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        kind = None

        def given() -> Iterator[tuple]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("conv_id").type
                for lo in range(0, b.num_rows, 256):
                    yield from zip(*(b.column(c).slice(lo, 256).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again")))

        found = _stream(given(), part, chunk, whole_rows)
        if (one := next(found, None)) is None:
            return
        schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in COUNTS), ("first", pa.string()), ("last", pa.string()),
                            ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int64()),
                            ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist([one], schema)
        yield from _batches(found, schema)

    both = stored(rows.mapInArrow(answer, f"conv_id {conv_type}, {counts}, first string, last string, {CHUNKS}"), "answers")
    out = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done, pieces = both.where("part IS NULL").select(*out), both.where("part IS NOT NULL")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        schema = pa.schema([("k_part", pa.int32()), ("k_seq", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), *((c, pa.int64()) for c in totals)])
        return _batches(_picked(_rows(batches)), schema)

    order = ["conv_id", "part", "seq"]
    small = pieces.select(*order, *COUNTS, "first", "last", "costs", "audits").repartition("conv_id").sortWithinPartitions(*order)
    path = stored(small.mapInArrow(pick, "k_part int, k_seq long, entry int, exit int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"), "path")
    chosen = pieces.select(*order, "audits", "roles", "texts").join(path, (F.col("part") == F.col("k_part")) & (F.col("seq") == F.col("k_seq")))
    piece = F.element_at("audits", F.col("entry") * 4 + F.col("exit") + 1)
    ends = F.when(F.col("cost").isNull(), "").when(F.col("exit") == SYSTEM, DONE[SYSTEM]).when(F.col("exit") == USER, DONE[USER]).otherwise("")
    chosen = chosen.select(*order, "entry", F.concat(piece, ends).alias("audit"), "roles", "texts", *out[1:7])

    @F.pandas_udf("lines long, body binary")
    def mend(entry, audit, roles, texts):
        import pandas as pd
        lines = [repaired([Row(r, t) for r, t in zip(rs, ts)], a, e) for e, a, rs, ts in zip(entry, audit, roles, texts)]
        return pd.DataFrame({"lines": [len(x) for x in lines], "body": ["\n".join(x).encode("utf-8", "surrogatepass") for x in lines]})

    mended = chosen.withColumn("m", mend("entry", "audit", "roles", "texts")).select(*order, "audit", *out[1:7], "m.lines", "m.body")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *((c, pa.int64()) for c in out[1:7]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def given() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _batches(({**{c: r[c] for c in out[:7]}, "audit": "".join(r["audit"]), "repaired_sha256": r["hash"].hexdigest()} for r in _joined(_rows(given()))), schema, 16)

    rest = mended.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(join, f"conv_id {conv_type}, {ANSWER}")
    return done.unionByName(rest)
