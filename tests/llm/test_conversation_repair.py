"""Conversation repair against its SQL, and against a search over all edits that shares nothing with it."""

import hashlib
import heapq
import re
import sys
import zlib
from itertools import count
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

from quillon.llm import conversation_repair as cr  # noqa: E402

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault), by uniform-cost search; the least audit of all cheapest."""
    best, tie = None, count()
    queue = [(0, "", next(tie), 0, ())]
    while queue:
        cost, audit, _, at, out = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) and best is None:
            best = (cost, audit, out)
        if cost > 4 * len(rows):
            continue
        for role in ("user", "assistant"):
            if len(out) - at < 3:
                heapq.heappush(queue, (cost + 3, audit + "I", next(tie), at, (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", next(tie), at + 1, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                heapq.heappush(queue, (cost + more, audit + "K", next(tie), at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 3, audit + "R", next(tie), at + 1, (*out, (new, text))))
    return best


def plain(table):
    ids, rows = {r[0] for r in table}, []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        q = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if q:
            rows += [(conv, turn, "user" if q == 4 else role, "" if q == 1 else re.sub("[.!?]", "", text) if q == 2 else text)] * (2 if q == 3 else 1)
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, seen, read = {r[1] for r in own} - {None}, set(), []
        for _, _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            read.append((role, text, "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit, lines = cheapest(read)
        initials = [r[:1] for r, _, _ in read]
        faults = [f for *_, f in read]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, cr.repair(df).select(*COLUMNS).collect()), key=repr)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(cr.OP13_SQL)
    assert want.columns == COLUMNS
    assert sorted(map(tuple, cr.op13(spark, sf).select(*COLUMNS).collect())) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def odd():
    """Null ids, turns, roles and texts, empty and unknown roles, repeated turns and rows, trailing spaces."""
    rng = np.random.default_rng(11)
    roles, texts = ["user", "assistant", "system", "uncle", "", None, "tool"], ["Yes.", "no", "", None, "Why? \n", " \t", "é!", "and "]
    rows = [(conv if conv < 60 else None, int(rng.integers(0, 5)) if rng.random() < 0.85 else None, roles[int(rng.choice(7, p=[0.35, 0.3, 0.1, 0.05, 0.05, 0.1, 0.05]))], texts[int(rng.integers(8))]) for conv in range(61) for _ in range(int(rng.integers(1, 6)))]
    return rows + rows[:3]


def test_odd_rows(spark, odd):
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit("x"), "block": F.lit(1), "copies": F.lit(7), "n": F.lit(2)}).repartition(4)
    assert got(df) == plain(odd)


def test_split_conversations(spark, odd, monkeypatch):
    """Blocks of three rows: nearly every conversation is split, one over many blocks; the results are the same."""
    long = [(70, k // 3, "user" if k * 7 % 5 < 3 else "assistant", f"text {k % 40}" + "." * (k % 6 > 0)) for k in range(400)] + [(71, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(9)]
    df = spark.createDataFrame(odd + long, "conv_id long, turn long, role string, text string").repartition(3)
    whole = got(df)
    monkeypatch.setattr(cr, "BLOCK_ROWS", 3)
    assert got(df) == whole
    assert [r for r in whole if r[0] != 70] == plain([r for r in odd + long if r[0] != 70])


def test_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "a" * 9_000_000 + "."), (1, 1, "assistant", "b."), (2, 0, "user", "c.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(df) == plain(rows)
    assert got(df.filter("conv_id > 5")) == []
