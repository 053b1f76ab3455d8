"""The ledger does not depend on the order of its rows, and a second pass changes nothing."""

from pyspark.sql import functions as F

from quillon.operators import changes, ledger
from quillon.plans.ledger_queries import listed


def test_order_does_not_matter(spark, sf):
    rows, known = listed(spark, sf)
    want = sorted(map(tuple, ledger.mapped(rows, known).collect()))
    for seed in (1, 2):
        shuffled = (df.repartition(5 + seed).orderBy(F.rand(seed)) for df in (rows, known))
        assert sorted(map(tuple, ledger.mapped(*shuffled).collect())) == want


def test_steps_of_a_small_ledger(spark):
    known = spark.createDataFrame([(1, "1", "a"), (2, "1", "a"), (3, "3", "b"), (4, "4", "c"), (6, "6", "f")], "source long, id string, last_key string")
    rows = spark.createDataFrame([(1, "a", True), (2, "x", True), (3, "a", True), (5, "c", True), (7, "f", True), (6, "f", False), (8, "n", True)], "source long, key string, live boolean")
    # 1 and 3 are one group now: the smaller id stays; 2 has left the line; 5 takes the line of 4, which is gone; 6 is not live.
    assert {r.key: (r.id, r.how) for r in ledger.assign(rows, known).collect()} == {"a": ("1", "kept"), "x": ("2", "new"), "c": ("4", "back"), "f": ("6", "back"), "n": ("8", "new")}
    assert [tuple(r) for r in ledger.merges(rows, known).collect()] == [("3", "1")]
    assert {r.source: r.moved_from for r in ledger.mapped(rows, known).collect()} == {1: None, 2: "1", 3: "3", 5: None, 6: None, 7: None, 8: None}
    again = ledger.next_ledger(rows, known)
    assert ledger.mapped(rows, again).filter("moved_from IS NOT NULL").isEmpty()
    none = rows.filter("false")
    assert ledger.assign(none, known).isEmpty() and ledger.mapped(rows, known.filter("false")).count() == 6


def test_only_appended_logs_pass(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "n long, x string")
    assert changes.appended(log, log.union(spark.createDataFrame([(3, "c")], log.schema)), "n", ["n", "x"]).isEmpty()
    assert [tuple(r) for r in changes.appended(log, log.filter("n = 2").withColumn("x", F.lit("z")), "n", ["n", "x"]).orderBy("n").collect()] == [(1, "lost"), (2, "changed")]
