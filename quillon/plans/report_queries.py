"""Queries of the curators' reports and of schedule wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedule
from ..functions.text import norm
from ..operators import curation
from .catalog import query, table


@query(
    "name_status",
    "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'urgent' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer' ELSE 'neither' END AS status FROM customer",
)
def name_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sources = {"urgent": o.filter("o_orderpriority = '1-URGENT'"), "buyer": o}
    return curation.first_source(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", sources, "neither")


@query(
    "mint_plan",
    """
WITH c AS (SELECT lower(p_type) AS key, p_type || repeat('!', p_size % 3) AS spelling, p_brand FROM part),
k AS (SELECT key, spelling, count(*) AS n FROM c GROUP BY ALL),
o AS (SELECT * FROM k WHERE key NOT IN (SELECT lower(p_type) FROM part WHERE p_retailprice <= 900)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(spelling), spelling) AS r, max(n) OVER (PARTITION BY key) AS top FROM o)
SELECT key, any_value(spelling) FILTER (WHERE r = 1) AS spelling, CAST(sum(n) AS BIGINT) AS n, count(*) AS spellings, count(*) FILTER (WHERE n = top) > 1 AS tied FROM r GROUP BY key
""",
)
def mint_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.concat("p_type", F.repeat(F.lit("!"), (F.col("p_size") % 3).cast("int"))).alias("name"))
    known = p.filter("p_retailprice <= 900").select(F.lower("p_type").alias("key"))
    return curation.mint_plan(names, known, "name", norm(F.col("name")))


@query(
    "removed_content",
    """
WITH prev AS (SELECT o_orderkey AS id, o_custkey AS key FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), cur AS (SELECT o_orderkey AS id, o_custkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM cur c WHERE c.key = p.key AND c.id NOT IN (SELECT id FROM prev)) THEN 'added' WHEN EXISTS (SELECT 1 FROM cur c WHERE c.key = p.key) THEN 'kept' ELSE 'gone' END AS went
FROM prev p WHERE id NOT IN (SELECT id FROM cur)
""",
)
def removed_content(spark, sf_dir):
    """Orders of two overlapping spans of time: what became of those the later one lacks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), "o_orderdate")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return curation.where_removed_went(o.filter(F.col("o_orderdate") < day("1996-01-01")).select("id", "key"), o.filter(F.col("o_orderdate") >= day("1995-01-01")).select("id", "key"), "id", "key")


@query(
    "link_classes",
    """
WITH p AS (SELECT o_orderkey, 'n' || c_nationkey AS old, CASE o_orderstatus WHEN 'F' THEN 'n' || c_nationkey WHEN 'O' THEN 'r' || n_regionkey ELSE NULL END AS new FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT moved, count(*) AS n FROM (SELECT CASE WHEN old IS NOT DISTINCT FROM new THEN 'same' WHEN new IS NULL THEN 'lost' ELSE 'wider' END AS moved FROM p) GROUP BY moved
""",
)
def link_classes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    node, region = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    pairs = pairs.select("o_orderkey", node.alias("old"), F.when(F.col("o_orderstatus") == "F", node).when(F.col("o_orderstatus") == "O", region).alias("new"))
    closure = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), region.alias("ancestor"))
    return curation.link_class(pairs, closure, "old", "new").groupBy("moved").agg(F.count("*").alias("n"))


@query(
    "order_only_changes",
    """
WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN a = b THEN 'same' ELSE 'order' END AS change FROM l
""",
)
def order_only_changes(spark, sf_dir):
    """Return flags of an order by line and by shipping date: the same, or only in another order."""
    by = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c, "l_returnflag"))), lambda x: x.l_returnflag)
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(by("l_linenumber", "l_partkey", "l_suppkey").alias("a"), by("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("b"))  # noqa: E741
    return curation.reordered(l, "a", "b").select("l_orderkey", "change")


@query(
    "run_of_event",
    """
WITH runs AS (SELECT event_id AS run, ts AS s, ts + INTERVAL 20 MINUTE AS e, value > 100 AS good FROM events WHERE event_type = 'signup'),
f AS (SELECT p.event_id, count(*) AS n, count(*) FILTER (WHERE good) AS g, min(run) AS one, min(run) FILTER (WHERE good) AS chosen FROM events p JOIN runs r ON p.ts BETWEEN r.s AND r.e WHERE p.event_type = 'purchase' GROUP BY ALL)
SELECT p.event_id, CASE WHEN g = 1 THEN chosen WHEN n = 1 THEN one END AS run FROM events p LEFT JOIN f USING (event_id) WHERE p.event_type = 'purchase'
""",
)
def run_of_event(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("e"), (F.col("value") > 100).alias("good"))
    return curation.made_by(e.filter("event_type = 'purchase'").select("event_id", "ts"), runs, "event_id", "ts", "s", "e", "id", "good", "HOUR").select("event_id", "run")


@query(
    "day_heads",
    "SELECT event_id, coalesce(CAST(ts AS DATE) IS DISTINCT FROM lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS head FROM events",
)
def day_heads(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return curation.heads(e, ["user_id"], ["ts", "event_id"], "day").select("event_id", "head")


@query(
    "fitting_lines",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS upto FROM conversations) WHERE upto <= 900",
)
def fitting_lines(spark, sf_dir):
    return curation.fitting(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 900).select("conv_id", "turn")


@query(
    "spoken_times",
    """
SELECT o_orderkey, o_orderdate + INTERVAL 690 MINUTE AS at, CAST(60 * (1 + o_orderkey % 3) + 15 * (o_orderkey % 4) AS INTEGER) AS minutes, o_orderdate + INTERVAL 690 MINUTE AS last
FROM orders
""",
)
def spoken_times(spark, sf_dir):
    """Dates written out and read back, durations in words."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate") + F.expr("INTERVAL 690 MINUTES")
    said = o.select("o_orderkey", F.year("o_orderdate").alias("y"), F.date_format(at, "EEEE, MMM d h:mm a").alias("d"), F.concat(1 + F.col("o_orderkey") % 3, F.lit(" hours "), 15 * (F.col("o_orderkey") % 4), F.lit(" minutes")).alias("long"))
    ends = schedule.range_ends(F.concat("d", F.lit(" — "), "d"))
    return said.select("o_orderkey", schedule.spoken_time(F.col("d"), F.col("y")).alias("at"), schedule.duration_minutes(F.col("long")).alias("minutes"), schedule.spoken_time(ends["last"], F.col("y")).alias("last"))
