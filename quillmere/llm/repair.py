"""Repair of conversation structure by lazy weighted determinisation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x20\x09-\x0D]"
#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of (s?(ua)+)? by what was said last: nothing, system, user, assistant. An inserted or reroled turn leads to:
_FOLLOWS = (2, 2, 3, 2)
#: Where a kept turn leads to, by state and initial (s, u, a, other); -1: nowhere.
_KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_ENDS = (0, 3)
_FAR = 1 << 30
NO_FAULT, BLANK, DUPLICATE, CUT, GONE = range(5)


def _closed(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_FOLLOWS[q]]) for q, c in enumerate(costs)]
    return costs


class Repairer:
    """Cheapest repairs of rows given as bytes: initial (0 to 3 for s, u, a, other) + 4 * fault.

    Rows are scanned from the last to the first. After a scan of rows i to n the automaton's
    state is the vector of the least costs from each state of the wanted language to its end,
    less their minimum; such vectors are numbered as they come up, and the number and the
    minimum that a row leads to are kept in a table, so a scan looks up one cell for each row.
    The trace goes back over the scan, from the first row to the last, along edits whose cost is
    the difference of the two vectors; at most one edit of each letter leaves a state, so taking
    the least letter at each step spells the least audit. What a cell's trace spells is kept too.
    """

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.start, self.offset = self._state(_closed([0 if q in _ENDS else _FAR for q in range(4)]))

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 16)
        return self.number[vector], least

    @staticmethod
    def _edits(row: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Letter, cost and next state of the edits that use up a row, letters ascending."""
        initial, fault = row & 3, row >> 2
        yield "D", DELETE, q
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if _KEPT[q][initial] >= 0:
                yield "K", KEEP + more, _KEPT[q][initial]
            yield "R", REROLE + more, _FOLLOWS[q]

    def _cell(self, state: int, row: int) -> tuple[int, int]:
        after = self.vectors[state]
        cell = self._state(_closed([min(cost + after[to] for _, cost, to in self._edits(row, q)) for q in range(4)]))
        self.table[state][row] = cell
        return cell

    def _spelled(self, after: int, row: int, q: int) -> tuple[str, int]:
        """What the trace writes from state q until the row is used up, and where it is then."""
        cell, least = self.table[after][row]
        here, beyond, first, letters = self.vectors[cell], self.vectors[after], q, ""
        while True:
            tight = [(letter, to) for letter, cost, to in self._edits(row, q) if cost + beyond[to] == here[q] + least]
            if INSERT + here[_FOLLOWS[q]] == here[q]:
                tight.append(("I", -1))
            letter, to = min(tight)
            letters += letter
            if letter != "I":
                self.traced[after, row, first] = letters, to
                return letters, to
            q = _FOLLOWS[q]

    def repair(self, rows: bytes) -> tuple[int, str]:
        """Least cost and the ASCII-least audit of that cost."""
        table, state, cost = self.table, self.start, self.offset
        states = np.zeros(len(rows), np.int32)  # the state after each row
        for i in range(len(rows) - 1, -1, -1):
            states[i] = state
            state, more = table[state][rows[i]] or self._cell(state, rows[i])
            cost += more
        cost += self.vectors[state][0]
        q, out, traced = 0, [], self.traced
        for after, row in zip(states.tolist(), rows, strict=True):
            letters, q = traced.get((after, row, q)) or self._spelled(after, row, q)
            out.append(letters)
        while q not in _ENDS:
            out.append("I")
            q = _FOLLOWS[q]
        return cost, "".join(out)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with nulls as one space and what their order within a turn goes by."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank(F.col("role").cast("string")).alias("role"), blank(F.col("text").cast("string")).alias("text"), F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _marked(rows: DataFrame) -> DataFrame:
    """Keyed rows without their texts: initial and fault, duplicates known from the first turn that said the same.

    What stands once in a conversation is no duplicate; only what is said again is joined with
    its first turn, so the joined side holds repeats alone. Rows equal in all columns are told
    apart where they stand side by side, in _segments().
    """
    last = F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("gone"), F.lit(GONE)).when(last == "", F.lit(BLANK)).when(~last.isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(NO_FAULT))
    initial = F.coalesce(F.expr("nullif(position(left(role, 1) in 'sua'), 0)"), F.lit(4)) - 1
    rows = rows.select("conv_id", "turn", "role", "digest", F.when(F.col("role") == "", F.lit(3)).otherwise(initial).cast("int").alias("initial"), fault.alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.where(F.col("fault") != GONE).groupBy(F.col("conv_id").alias("again_id"), F.col("digest").alias("again")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    joined = rows.join(again, rows.conv_id.eqNullSafe(again.again_id) & (rows.digest == again.again), "left")
    repeat = F.col("fault").isin(NO_FAULT, CUT) & F.coalesce(place > F.col("first"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "digest", "initial", F.when(repeat, F.lit(DUPLICATE)).otherwise(F.col("fault")).cast("int").alias("fault"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to one row for each run of a conversation in a batch: its rows as bytes, and its turns."""
    from pyspark import TaskContext

    at, before = TaskContext.get().partitionId() << 32, None
    for batch in batches:
        convs, turns, roles, digests, initial, fault = (c.to_pylist() for c in batch.columns)
        out: dict[str, list] = {k: [] for k in ("conv_id", "at", "marks", "first_turn", "last_turn", "turns")}
        marks: bytearray = bytearray()
        for k, conv in enumerate(convs):
            if not k or conv != convs[k - 1]:
                marks = bytearray()
                for name, value in (("conv_id", conv), ("at", at), ("marks", marks), ("first_turn", None), ("last_turn", None), ("turns", 0)):
                    out[name].append(value)
                at += 1
            if fault[k] == GONE:
                continue
            key = (conv, turns[k], digests[k])
            same, before = key == before, key
            marks.append(initial[k] + 4 * (DUPLICATE if same and fault[k] != BLANK else fault[k]))
            if turns[k] is not None:
                if out["first_turn"][-1] is None:
                    out["first_turn"][-1] = turns[k]
                if out["last_turn"][-1] != turns[k]:
                    out["last_turn"][-1] = turns[k]
                    out["turns"][-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([bytes(m) for m in v], pa.binary()) if name == "marks" else pa.array(v, pa.int64()) for name, v in out.items()], list(out))


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to one row for each conversation."""
    repairer, legal = Repairer(), np.zeros(16, bool)
    legal[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au
    key: object = repairer  # no conversation yet
    parts: list[bytes] = []
    low = high = None
    turns = 0

    def row() -> tuple:
        rows = b"".join(parts)
        marks = np.frombuffer(rows, np.uint8)
        count = np.bincount(marks >> 2, minlength=5)
        pairs = ((marks[:-1] & 3) << 2) + (marks[1:] & 3)
        gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
        return (key, gaps, int(count[BLANK]), int(count[DUPLICATE]), int(count[CUT]), int((~legal[pairs]).sum()), *repairer.repair(rows))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split(" ")[0] for c in _AUDIT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if name == "audit" else pa.int64()) for k, name in enumerate(names)], names)

    for batch in batches:
        out = []
        for conv, _, marks, first, last, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is repairer or conv != key:
                if key is not repairer:
                    out.append(row())
                key, parts, low, high, turns = conv, [], None, None, 0
            parts.append(marks)
            if first is not None:
                turns += n - (first == high)
                low, high = first if low is None else low, last
        if out:
            yield batch_of(out)
    if key is not repairer:
        yield batch_of([row()])


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cheapest cost and audit of each conversation of `rows` (conv_id, turn, role, text, and optionally gone).

    A conversation's rows are in order of turn (null first), role and the SHA-256 of their text;
    nulls are one space. Rows that are `gone` count for nothing, but their conversation has a
    row. Each row's first fault counts: blank, duplicate (role and text stood earlier), truncated.
    Audits spell the edits in order: K(eep), R(erole), D(elete), I(nsert).

    Rows are dealt by ranges of their order, so a long conversation lies in many tasks; each
    gives a byte for a row. A conversation's bytes then meet in one task, as many as the audit it
    returns has letters at least. A conversation without rows has zeros and an empty audit. An empty
    role has no initial and can't be kept. An empty table gives no rows. Other columns are not read.
    """
    order = ("conv_id", "turn", "role", "digest")
    dealt = _marked(_keyed(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = dealt.mapInArrow(_segments, "conv_id long, at long, marks binary, first_turn long, last_turn long, turns long")
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_audits, _AUDIT)


def _repaired(batches: Iterator[pa.RecordBatch], say: Callable[[dict, int, str, str, str], None], over: Callable[[dict], None], give: Callable[[], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk through conversations, each an audit and then its rows in order.

    say() is told the audit's columns, place, edit, role and text of each repaired row, over()
    the audit's columns at a conversation's end; give() is asked for what they made after each batch.
    """
    info: dict | None = None
    audit, at, place, last = "", 0, 0, ""

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place, last
        say(info, place, edit, role, text)
        place, last = place + 1, role[:1]

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            put("I", "assistant" if last == "u" else "user", "")

    for batch in batches:
        heads, turns_roles = batch.column("head"), (batch.column("role"), batch.column("text"))
        for k in range(batch.num_rows):
            if heads[k].is_valid:
                if info is not None:
                    inserts()
                    over(info)
                info = heads[k].as_py() | {"conv_id": batch.column("conv_id")[k].as_py()}
                audit, at, place, last = info["audit"], 0, 0, ""
                continue
            role, text = (c[k].as_py() for c in turns_roles)
            inserts()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(edit, role if edit == "K" else "assistant" if last == "u" else "user", text)
        yield give()
    if info is not None:
        inserts()
        over(info)
        yield give()


def _told(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, a conversation in one task: they are read one after the other and not held."""
    columns = [c for c in found.columns if c != "conv_id"]
    heads = found.select("conv_id", F.struct(*columns).alias("head"))
    both = _keyed(rows).where("not gone").unionByName(heads, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "role", "digest").select("conv_id", "head", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn that is kept, reroled or inserted: conv_id, place (from 0), edit, role, text.

    Rows and order are those of audits(). A text is carried whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        def say(info: dict, place: int, edit: str, role: str, text: str) -> None:
            held.append({"conv_id": info["conv_id"], "place": place, "edit": edit, "role": role, "text": text})

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(held, schema)
            held.clear()
            return out

        yield from _repaired(batches, say, lambda info: None, give)

    return _told(rows, audits(rows)).mapInArrow(work, "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """audits() and, as repaired_sha256, the SHA-256 of each repaired conversation's `role:text` lines.

    A digest is taken over a conversation's texts one after the other, so one task reads all of
    a conversation, but holds no more than its audit and a batch of rows.
    """
    kind = _AUDIT + ", repaired_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        done: list[dict] = []
        schema = pa.schema([(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in kind.split(", ")])

        def say(info: dict, place: int, edit: str, role: str, text: str) -> None:
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())

        def over(info: dict) -> None:
            nonlocal digest
            done.append(info | {"repaired_sha256": digest.hexdigest()})
            digest = hashlib.sha256()

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(done, schema)
            done.clear()
            return out

        yield from _repaired(batches, say, over, give)

    return _told(rows, audits(rows)).mapInArrow(work, kind)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops a row (it is kept as `gone`), 1 empties its text, 2 takes its marks, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")
