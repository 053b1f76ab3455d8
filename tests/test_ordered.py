"""Places, values as of moments, medians, columns, keys and cells on odd rows, with a key that holds nearly all of them, and
the plans that they promise."""

import sys
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from quillon.operators import layout, listing, ordered, search  # noqa: E402


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_places(spark):
    rng = np.random.default_rng(1)
    rows = [(k, None if k % 50 == 0 else int(rng.integers(0, 9))) for k in range(3000)]
    got = ordered.numbered(spark.createDataFrame(rows, "id long, v int").repartition(7), [F.col("v").asc_nulls_first(), F.col("id")])
    assert "SinglePartition" not in executed(got)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert sorted((r.r, r.id) for r in got.collect()) == [(k + 1, i) for k, (i, _) in enumerate(want)]
    assert ordered.numbered(spark.createDataFrame([], "id long, v int"), [F.col("id")]).collect() == []


@pytest.mark.parametrize("by", [[], ["k"]])
def test_as_of(spark, by):
    rng = np.random.default_rng(2)
    left = [(i, None if i % 97 == 0 else int(rng.integers(0, 2000)), "hot" if i % 20 else f"k{i % 3}") for i in range(2500)]
    right = [(int(rng.integers(0, 2000)), "hot" if j % 10 else "k1", None if j % 7 == 0 else j, j) for j in range(120)]
    got = ordered.as_of(spark.createDataFrame(left, "id long, at long, k string"), spark.createDataFrame(right, "slot long, k string, v long, tie long"), by, "at", "slot", "v", "tie")
    assert "SinglePartition" not in executed(got) or not by  # without a key the window over parts, a row a part, is one task
    for r in got.collect():
        held = [(s, t, v) for s, k, v, t in right if r.at is not None and s <= r.at and (not by or k == r.k)]
        assert r.as_of_v == (max(held, key=lambda x: x[:2])[2] if held else None)


def test_medians(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 8, 4001)] + [("few", x) for x in (3.5, -1e300, 1e300, 3.5)] + [("one", -0.25), ("none", None), (None, 7.0), (None, 8.0)] + [("same", 2.0)] * 300 + [("near", 1.0 + k * 2.0**-52) for k in range(9)]
    got = {r.k: (r.median, r.n) for r in ordered.exact_medians(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()}
    for k in ("hot", "few", "one", None, "same", "near"):
        own = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (own[len(own) // 2], len(own))
    assert len(got) == 6


def plain_columns(rows):
    out, opened, island = {}, [], 0
    for i, s, e in sorted(rows, key=lambda r: (r[1], r[0])):
        opened = [x for x in opened if x[0] > s]
        island += not opened
        col = min(set(range(len(opened) + 1)) - {c for _, c in opened})
        opened.append((e, col))
        out[i] = (island, col)
    wide = {n: max(c for m, c in out.values() if m == n) + 1 for n, _ in out.values()}
    return {i: (n, c, wide[n]) for i, (n, c) in out.items()}


@pytest.mark.parametrize("long", [3, 4000])
def test_columns_of_one_key(spark, long):
    """One key with all rows; with long intervals it is a single island over all parts."""
    rng = np.random.default_rng(long)
    start = datetime(2024, 1, 1)
    rows = [(i, int(s), int(s + rng.integers(0, long if i % 300 == 0 else 5))) for i, s in enumerate(rng.integers(0, 3000, 1200))]
    df = spark.createDataFrame([("u", i, start + timedelta(minutes=s), start + timedelta(minutes=e)) for i, s, e in rows] + [(None, 5000, start, start + timedelta(hours=1)), (None, 5001, start, start)], "u string, i long, s timestamp, e timestamp")
    got = layout.packed_columns(df, "u", "i", "s", "e").collect()
    assert {r.i: (r.island, r.col, r.cols) for r in got if r.u == "u"} == plain_columns(rows)
    assert {r.i: (r.island, r.col, r.cols) for r in got if r.u is None} == {5000: (1, 0, 2), 5001: (1, 1, 2)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_terms(spark):
    rng = np.random.default_rng(5)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 13))) for _ in range(900)} | {""})
    query = ["abcab", "abcabcabca", "aab", "cbacb", "bbbb"]
    got = search.fuzzy_terms(spark.createDataFrame([(t,) for t in terms], "term string"), query)
    assert "NestedLoop" not in executed(got)
    want = set()
    for q in query:
        most = len(q) // 5 if len(q) > 4 else 0
        for t in terms:
            how = "exact" if t == q else "prefix" if len(q) >= 4 and t.startswith(q) else "close" if most and distance(t, q) <= most else None
            want |= {(q, t, how)} if how else set()
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_longest_key(spark):
    keys = spark.createDataFrame([("north",), ("north hall",), ("North Hall B",), ("hall",), (None,)], "k string")
    rows = [(1, "North Hall b 3"), (2, "north hallway"), (3, "hall"), (4, None), (5, ""), (6, "northern"), (7, "NORTH  hall")]
    got = {r.id: (r.key, r.rest) for r in search.longest_key(spark.createDataFrame(rows, "id int, t string"), "t", keys, "k").collect()}
    assert got == {1: ("North Hall B", "3"), 2: ("north", "hallway"), 3: ("hall", ""), 4: (None, None), 5: (None, ""), 6: (None, "northern"), 7: ("north", "hall")}


def test_nearest_rect(spark):
    rng = np.random.default_rng(6)
    rects = [("p", k, *map(float, (x, y, x + rng.integers(0, 30), y + rng.integers(0, 30)))) for k, (x, y) in enumerate(rng.integers(-100, 100, (60, 2)))]
    points = [("p", k, *map(float, xy)) for k, xy in enumerate(rng.integers(-120, 140, (300, 2)))]
    got = {r.point: (r.rect, r.distance) for r in listing.nearest_rect(spark.createDataFrame(points, "plate string, point long, x double, y double"), spark.createDataFrame(rects, "plate string, rect long, x0 double, y0 double, x1 double, y1 double"), "plate", "point", "x", "y", 8.0).collect()}
    for _, k, x, y in points:
        d = [(round(float(np.hypot(max(r[2] - x, 0, x - r[4]), max(r[3] - y, 0, y - r[5]))), 9), -r[1]) for r in rects]
        best = min(d)
        assert got.get(k) == ((-best[1], best[0]) if best[0] <= 8 else None)


def test_nearest_rect_meets_copies_once(spark):
    """Of equal rectangles the largest id counts, of equal points each has its row; copies are folded before they meet."""
    rects = [("p", k, x, x, x + 2, x + 2) for k, x in enumerate([0.0, 0.0, 5.0, 0.0, 5.0])] + [("q", 9, 0.0, 0.0, 2.0, 2.0)]
    points = [("p", k, float(k % 3), 1.0) for k in range(12)] + [("p", 20, 4.5, 4.5), ("p", 21, 40.0, 0.0), ("q", 22, 3.0, 2.0), ("p", 23, 3.5, 3.5), ("q", 20, 1.0, 1.0), ("p", 24, None, 1.0)]
    found = listing.nearest_rect(spark.createDataFrame(points, "plate string, point long, x double, y double"), spark.createDataFrame(rects, "plate string, rect long, x0 double, y0 double, x1 double, y1 double"), "plate", "point", "x", "y", 8.0)
    got = {r.point: (r.rect, r.distance) for r in found.collect()}
    assert got == {k: (3, 0.0) for k in range(12)} | {20: (9, 0.0), 22: (9, 1.0), 23: (4, round(1.5 * 2**0.5, 9))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [plate#") >= 3  # rectangles, places, the best of a place
