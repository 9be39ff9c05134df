"""Cheapest repairs against a search over all edits, and conversations in every awkward form."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from quillmere.llm import repair
from quillmere.llm.oracles import ORACLE_SQL
from quillmere.llm.queries import op12_repair

SF = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit, repaired lines) by uniform-cost search over edits; rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(lines)
        need = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, need[0], (*lines, need + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == need[0] or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, need[0], (*lines, f"{need}:{text}")))
    raise AssertionError


def brute(rows):
    """The contract's columns for the rows (turn, role, text) of a conversation, in order."""
    seen, faulty, turns = set(), [], {t for t, _, _ in rows if t is not None}
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faulty.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""))
        seen.add((role, text))
    cost, audit, lines = cheapest(faulty)
    count = lambda f: sum(x[2] == f for x in faulty)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def damage(rows):
    """What the contract does to rows (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {conv: in_order(own) for conv, own in out.items()}


def test_every_short_conversation():
    repairer, code = repair.Repairer(), {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), "x", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(9))]
        assert repairer.repair(bytes(("sua".index(r[0]) if r and r[0] in "sua" else 3) + 4 * code[f] for r, _, f in rows)) == cheapest(rows)[:2]
    assert len(repairer.vectors) < 60


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((conv, *brute(own)) for conv, own in damage(rows).items())
    assert sorted(map(tuple, op12_repair(spark, SF).collect())) == want


@pytest.mark.parametrize("where", [SF, "/root/testdata/sf0.01"])
def test_query_is_its_sql(spark, where):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{where}/conversations.parquet'")
    got = op12_repair(spark, where)
    cur = con.execute(ORACLE_SQL["op12_repair"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())


ODD = [
    (None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "x."), (1, None, "user", "x."), (1, 2, "", "y."), (2, 5, "user", None), (3, 0, "system", ""), (4, 0, "sys", "a"),
    *[(5, 7, "user", "same.")] * 5, *[(6, t, "user", "again.") for t in range(40)], *[(7, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000) if t % 7], (8, -(1 << 62), "user", "far."), (8, 1 << 62, "assistant", "apart."), (9, 1, "user", "long " * 200_000),
]


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(*r, "?") for r in ODD], "conv_id long, turn long, role string, text string, digest string")
    want = {conv: brute(own) for conv, own in damage(ODD).items()}
    assert {r[0]: tuple(r)[1:] for r in repair.digests(repair.damaged(rows)).collect()} == want
    assert repair.digests(repair.damaged(rows.limit(0))).collect() == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(repair.repaired(repair.damaged(rows)).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, own in damage(ODD).items():
        assert hashlib.sha256("\n".join(got.get(conv, [])).encode()).hexdigest() == brute(own)[-1]
