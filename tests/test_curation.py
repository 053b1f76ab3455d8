"""Curation operators and schedule wording on odd rows."""

from pyspark.sql import functions as F

from quillon.functions import schedule
from quillon.operators import curation


def test_wording(spark):
    df = spark.createDataFrame([("1 hour 30 minutes", "Friday, Sep 4 11:30 AM", "a - b", "Ann Lee (Host)"), ("soon", "never", "a", "Bob"), (None, None, None, None)], "d string, t string, r string, n string")
    got = df.select(schedule.duration_minutes(F.col("d")).alias("d"), schedule.spoken_time(F.col("t"), F.lit(2026)).alias("t"), schedule.range_ends(F.col("r")).alias("r"), schedule.split_role(F.col("n")).alias("n")).collect()
    assert [r.d for r in got] == [90, None, None] and [str(r.t) for r in got] == ["2026-09-04 11:30:00", "None", "None"]
    assert [tuple(r.r) for r in got] == [("a", "b"), (None, None), (None, None)] and [tuple(r.n) for r in got] == [("Ann Lee", "Host"), ("Bob", None), (None, None)]
    odd = spark.sql("SELECT array('b','a') AS x, CAST(NULL AS array<string>) AS y, array('a','c','d') AS z, 'cafÃ©' AS m")
    r = odd.select(schedule.capped_union([F.col("x"), F.col("y"), F.col("z")], 3).alias("u"), schedule.mojibake(F.col("m")).alias("m"), schedule.half_up(F.lit(2.5)).alias("h")).first()
    assert (r.u, r.m, r.h) == (["b", "a", "c"], True, 3)


def test_cycles_are_found_and_trees_are_not(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None), (7, 7)], "c int, p int")
    assert sorted(r.node for r in curation.cycles(edges, "c", "p").collect()) == [1, 2, 3, 7]


def test_run_choice(spark):
    runs = spark.sql("SELECT * FROM VALUES (1, 0, 100, true), (2, 50, 200, false), (3, 150, 300, true), (4, 160, 300, true) AS t(r, a, b, good)").selectExpr("r", "timestamp_seconds(a) s", "timestamp_seconds(b) e", "good")
    points = spark.sql("SELECT * FROM VALUES (1, 60), (2, 120), (3, 170), (4, 999) AS t(i, a)").selectExpr("i", "timestamp_seconds(a) at")
    got = {r.i: r.run for r in curation.made_by(points, runs, "i", "at", "s", "e", "r", "good", "MINUTE").collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: None}


def test_link_classes(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", None), (None, "a"), ("a", "b"), ("b", "a"), ("a", "c"), (None, None)], "old string, new string")
    closure = spark.createDataFrame([("b", "a")], "id string, ancestor string")
    assert sorted(r.moved for r in curation.link_class(pairs, closure, "old", "new").collect()) == ["gained", "lost", "narrower", "other", "same", "same", "wider"]


def test_repaired(spark):
    """What Windows-1252 makes of UTF-8, curly quotes included; honest texts and what no misreading can have made stay."""
    from quillon.operators import listing

    texts = ["café", "“quoted – it’s", "naïve Ω", "plain", "", None, "€5 Straße", "Ã", "Â·", "日本", "ÃÃ", "é"]
    misread = [t if t is None else t.encode().decode("cp1252") for t in texts[:5]] + [None, "€5 Straße".encode().decode("cp1252")]

    def plain(t):
        try:
            return t if t is None else t.encode("cp1252").decode()
        except (UnicodeEncodeError, UnicodeDecodeError):
            return t

    for rows in (texts, misread):
        got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", listing.repaired(F.col("t")).alias("t")).orderBy("k").collect()]
        assert got == [plain(t) for t in rows]
    assert plain(misread[1]) == texts[1]


def test_merge_of_repeated_members(spark):
    """A group's rows are many, its members few; null members are none."""
    from quillon.operators import aggregate

    rows = [("a", k, f"t{k % 3}", "x" * (k % 4), None if k % 5 == 0 else f"m{k % 7}") for k in range(1, 400)] + [(None, 1000, None, None, None)]
    got = {r.group_key: r for r in aggregate.group_merge(spark.createDataFrame(rows, "g string, r long, t string, x string, m string").repartition(6), "g", "r", ["t"], "x", "m").collect()}
    assert (got["a"].r, got["a"].n, got["a"].t, got["a"].members) == (1, 399, "t1", ["m1", "m2", "m3", "m4", "m6", "m0", "m5"])
    assert got["a"].n == 399 and got[None].members == []


def test_roles_of_any_depth(spark):
    from quillon.functions import names

    rows = [("Ann Lee", None), ("Ann Lee (Judge)", "Judge"), ("Ann (B) Lee", None), ("Ann (a) (b)(c)  (d) ( ) ", "d"), ("(x)", "x"), ("", None), (None, None), ("A ((b))", None), ("Ann" + " (z)" * 50, "z")]
    got = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(rows)], "k int, n string").select("k", names.roles(F.col("n")).alias("r")).orderBy("k").collect()
    assert [r.r.role for r in got] == [role for _, role in rows]
    assert [r.r.name for r in got] == ["Ann Lee", "Ann Lee", "Ann (B) Lee", "Ann", "", "", None, "A ((b))", "Ann"]
