"""Picks: merging in any order, tombstones, null keys and stamps; lists dealt in turn."""

import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from quillon.operators import picks  # noqa: E402

NOW = datetime(2024, 3, 1, 12)
SCHEMA = "reader string, item long, stamp timestamp_ntz, picked boolean"


def drawn(n, seed):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice([1, 2, 3, None]), r.choice([None, NOW + timedelta(minutes=r.randint(-9, 9))]), r.random() < 0.5) for _ in range(n)]


def plain(stored, incoming):
    late = lambda s: datetime.min if s is None else s
    out = {(r, i): (s, p) for r, i, s, p in stored}
    best = {}
    for r, i, s, p in incoming:
        x = (None if s is None else min(s, NOW + timedelta(minutes=5)), p)
        best[r, i] = max(best.get((r, i), x), x, key=lambda x: (late(x[0]), x[1]))
    for k, x in best.items():
        if k not in out or late(x[0]) > late(out[k][0]):
            out[k] = x
    return out


def merge(spark, stored, incoming):
    got = picks.merged(spark.createDataFrame(stored, SCHEMA), spark.createDataFrame(incoming, SCHEMA).withColumn("came", F.lit(1)), ["reader", "item"], "stamp", ["picked"], F.lit(str(NOW)).cast("timestamp_ntz"))
    return [(r.reader, r.item, r.stamp, r.picked) for r in got.collect()]


def test_merge_and_replay(spark):
    """A null stamp is earlier than all others."""
    once = {(r, i): (r, i, s, p) for r, i, s, p in drawn(30, 1)}
    stored, incoming = list(once.values()), drawn(60, 2)
    got = merge(spark, stored, incoming)
    assert {(r, i): (s, p) for r, i, s, p in got} == plain(stored, incoming) and len(got) == len(plain(stored, incoming))
    assert sorted(merge(spark, got, incoming), key=repr) == sorted(got, key=repr)  # sent again
    assert {r[:2] for r in got} >= set(once)  # nothing is deleted
    assert merge(spark, [], []) == []


def test_dealt(spark):
    rows = [("x", k, f"i{k % 400}") for k in range(900)] + [("y", k, f"i{500 + k}") for k in range(5)] + [("z", 0, None), ("z", 1, "i0"), (None, 0, "n0")]
    got = [tuple(r) for r in picks.dealt(spark.createDataFrame(rows, "list string, at long, item string").repartition(9), "list", [F.col("at")], "item").orderBy("r").collect()]
    lists = {}
    for name, _, item in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        lists.setdefault(name, []).append(item)
    want, seen = [], set()
    for turn in range(900):
        for name in lists:
            if turn < len(lists[name]) and lists[name][turn] not in seen:
                seen.add(lists[name][turn])
                want.append((lists[name][turn], name, len(want) + 1))
    assert got == want
