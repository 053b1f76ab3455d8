"""Queries and operators over the whole of their input, against plain versions."""

import pytest

from quillon.operators import hierarchy, search
from quillon.plans import event_queries, text_queries


def ends(into, i):
    """As the reference follows merges: up to the first id that is not merged, or that was seen."""
    at, seen = i, set()
    while into.get(at) is not None and at not in seen:
        seen.add(at)
        at = into[at]
    return at


@pytest.mark.parametrize("length", [63, 64, 65, 200, 1000])
def test_long_merge_chains_end_in_their_survivor(spark, length):
    into = {k: k + 1 for k in range(length)} | {length: None, 5000: 3, 5001: 9999, 5002: None}
    got = {r.id: r.survivor for r in hierarchy.resolved(spark.createDataFrame(list(into.items()), "id long, merged_into long")).collect()}
    assert got == {i: ends(into, i) for i in into}


def test_rings_of_merges_stop(spark):
    into = {1: 2, 2: 3, 3: 1, 4: 2, 5: 4, 6: 6, 7: 6, 8: 9, 9: None}
    got = {r.id: r.survivor for r in hierarchy.resolved(spark.createDataFrame(list(into.items()), "id long, merged_into long")).collect()}
    assert got == {i: ends(into, i) for i in into}


def test_merge_chains_over_the_whole_ledger(spark, tmp_path):
    keys = sorted({*range(1, 30, 2), *range(900, 1100, 3), 2046, 2049, 4098, 7000, 7002, 7005, 70_000, 70_002})
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    into = {k: (b if k % 3 == 0 else None) for b, k in zip([None, *keys], keys)}
    got = {r.id: r.survivor for r in event_queries.merge_chains(spark, str(tmp_path)).collect()}
    assert got == {i: ends(into, i) for i in into}


def test_two_of_three_over_every_part(spark, tmp_path):
    parts = [(k, f"b{k % 3}" if k % 11 else None, f"t{k % 4}", k % 5) for k in range(1, 90)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    later = [(k, "X" if k % 23 == 3 else x, y, None if k % 37 == 5 else z) for k, x, y, z in parts]
    want = sorted((a[0], b[0]) for a in parts for b in later if sum(u is not None and u == v for u, v in zip(a[1:], b[1:])) >= 2)
    got = sorted((r.gone, r.new) for r in text_queries.two_of_three(spark, str(tmp_path)).collect())
    assert got == want and {a for a, _ in got} == {k for k, *_ in parts}


def test_two_of_three_shuffles_no_pairs(spark):
    """Pairs are found once; those of ids in several rows, null ids among them, are made distinct."""
    from quillon.operators import identity

    rows = [(k, k % 3 or None, k % 4, k % 5) for k in range(60)]
    again = [(7, 1, 1, 1), (7, 1, 1, 2), (None, 1, 2, 3), (None, 1, 2, 4), (8, 2, 0, 3)]
    frame = lambda r: spark.createDataFrame(r, "id long, x long, y long, z long")
    for a, b in ((rows, rows[:40]), (rows + again, rows), (rows, rows + again), (rows + again, again + rows)):
        want = {(p[0], q[0]) for p in a for q in b if sum(u is not None and u == v for u, v in zip(p[1:], q[1:])) >= 2}
        got = [tuple(r) for r in identity.two_of_three(frame(a), frame(b), "id", ["x", "y", "z"]).collect()]
        assert len(got) == len(want) and set(got) == want
    plan = identity.two_of_three(frame(rows), frame(rows), "id", ["x", "y", "z"])._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [gone" in line and "new" in line for line in plan.splitlines())


def test_prefix_matches_of_any_length(spark):
    words = ["widget", "widgets", "widget" + "like" * 9, "wodget", "widge", "budget", "smal", "smallest" + "x" * 40, "abc", "abcd", "1234567890" * 7]
    got = sorted((r.query, r.term, r.how) for r in search.fuzzy_terms(spark.createDataFrame([(w,) for w in words], "term string"), ["widget", "smal", "abc", "1234567890" * 6]).collect())
    assert got == sorted([
        ("widget", "widget", "exact"), ("widget", "widgets", "prefix"), ("widget", "widget" + "like" * 9, "prefix"), ("widget", "wodget", "close"), ("widget", "widge", "close"),
        ("smal", "smal", "exact"), ("smal", "smallest" + "x" * 40, "prefix"), ("abc", "abc", "exact"), ("1234567890" * 6, "1234567890" * 7, "prefix"),
    ])


def test_closure_of_a_long_chain(spark):
    """A chain of 100 nodes, all of whose pairs are there at their depths; and a ring, in which all reach all."""
    from quillon.operators import curation

    chain = spark.createDataFrame([(k, k + 1 if k < 99 else None) for k in range(100)], "id long, parent long")
    got = {(r.id, r.ancestor): r.depth for r in hierarchy.closure(chain).collect()}
    assert got == {(a, b): b - a for a in range(100) for b in range(a, 100)}
    assert curation.cycles(chain, "id", "parent").isEmpty()
    ring = spark.createDataFrame([(k, (k + 1) % 7) for k in range(7)] + [(50, 3), (51, 50)], "id long, parent long")
    assert {(r.id, r.ancestor) for r in hierarchy.closure(ring).collect()} >= {(a, b) for a in range(7) for b in range(7)}
    assert sorted(r.node for r in curation.cycles(ring, "id", "parent").collect()) == list(range(7))


@pytest.mark.parametrize("step", [1, 2, 8])
def test_in_place_takes_what_a_walk_over_all_rows_takes(spark, step):
    """Windows from any moment, hot sessions and buildings, null buildings, scores of 0 and ties, lists that end and go on."""
    import datetime
    import random

    from pyspark.sql import functions as F

    from quillon.operators import choices

    rng, day = random.Random(step), datetime.datetime(2024, 1, 1)
    items = [(k, rng.choice([1, 1, 1, 2, 3, 4, 9, None]), day + datetime.timedelta(hours=rng.randrange(0, 200, 6)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(250)]
    vacated = [(u, day + datetime.timedelta(hours=h), day + datetime.timedelta(hours=h + rng.choice([0, 20, 60, 400])), rng.choice(["a", "b", "z", None])) for u, h in ((u, rng.randrange(-30, 260)) for u in range(60))]
    scores = [(u, k, rng.choice([0.0, 0.5, 1.0]), rng.choice(["x", "y", None])) for u in range(60) for k in rng.sample(range(250), 9)]
    i, v = spark.createDataFrame(items, "item long, session long, s timestamp_ntz, building string"), spark.createDataFrame(vacated, "u long, from timestamp_ntz, to timestamp_ntz, building string")
    sc = spark.createDataFrame(scores, "u long, item long, score double, reason string")
    near = choices.in_window(i, v, "u", "item", "s").join(i.select("item", "session"), "item").filter("session <> u").join(sc, ["u", "item"], "left").fillna(0.0, ["score"])
    want = choices.chosen(near, "u", "item", "reason", "session", [F.desc("score"), F.desc("here"), F.col("s"), F.col("item")], 3)
    got = choices.in_place(i, v, sc, F.col("session") != F.col("u"), "u", "item", "reason", "session", "s", 3, step)
    assert sorted(map(tuple, got.select("u", "item", "r").collect())) == sorted(map(tuple, want.select("u", "item", "r").collect()))


def test_loose_matches_of_one_title_are_dealt_to_several_tasks(spark):
    from quillon.operators import changes

    rows = [(k, "The Show" if k % 9 else None, k % 3 if k % 5 else None, f"r{k % 2}") for k in range(120)]
    new = [(1000 + k, " the  SHOW!" if k % 7 else "Other", k % 3 if k % 4 else None, f"r{k % 2}") for k in range(50)]
    frame = lambda r: spark.createDataFrame(r, "id long, title string, start long, room string")
    found = changes.loosely_matched(frame(rows), frame(new), "id", "title", "start", "room")
    kinds = {(True, True): "both", (True, False): "start", (False, True): "room", (False, False): "none"}
    want = sorted((a[0], b[0], kinds[a[2] != b[2], a[3] != b[3]]) for a in rows for b in new if a[1] and b[1] != "Other")
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression [_t" in line and "_part" in line for line in plan.splitlines())
