"""Queries of what goes out, over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, delivery, ordered
from .catalog import query, table


@query("due_changes", "SELECT l_orderkey AS id, l_linenumber, l_returnflag AS kind, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate - INTERVAL 60 DAY AND o_orderstatus <> 'P'")
def due_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_returnflag").alias("kind"), (F.col("l_shipdate") - F.expr("INTERVAL 60 DAY")).alias("run"))
    picks = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("picked"))
    return delivery.due_changes(changes, picks, o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), "id", "run", "picked").select("id", "l_linenumber", "kind", "user_id")


@query("user_endpoints", "WITH p AS (SELECT DISTINCT user_id, 'https://push/' || event_type AS e FROM events WHERE value > 40), j AS (SELECT user_id, '[' || string_agg('\"' || e || '\"', ',' ORDER BY e) || ']' AS endpoints FROM p GROUP BY user_id) SELECT c_custkey AS user_id, endpoints FROM customer JOIN j ON c_custkey = user_id")
def user_endpoints(spark, sf_dir):
    endpoints = table(spark, sf_dir, "events").filter("value > 40").select("user_id", F.concat(F.lit("https://push/"), "event_type").alias("endpoint"))
    return delivery.with_endpoints(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), endpoints, "user_id", "endpoint")


@query("delivery_verdicts", "WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 201 WHEN 1 THEN 410 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 400 END AS status, event_id % 5 AS tries FROM events) SELECT CASE WHEN status BETWEEN 200 AND 299 THEN 'ack' WHEN status IN (404, 410) THEN 'prune' WHEN (status IS NULL OR status = 429 OR status >= 500) AND tries < 3 THEN 'hold' ELSE 'release' END AS verdict, count(*) AS n FROM a GROUP BY 1")
def delivery_verdicts(spark, sf_dir):
    status = F.get(F.array(*[F.lit(s) for s in (201, 410, 429, 503, 400)]), (F.col("event_id") % 6).cast("int"))
    answers = table(spark, sf_dir, "events").select(status.alias("status"), (F.col("event_id") % 5).alias("tries"))
    return delivery.verdicts(answers, "status", "tries").groupBy("verdict").agg(F.count("*").alias("n"))


_OUTBOX = "WITH k AS (SELECT * FROM (SELECT event_type, user_id, event_id, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1)\n"


@query("outbox_pending", _OUTBOX + "SELECT event_type, user_id, event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id) - 1) // 20 AS BIGINT) AS batch FROM k")
def outbox_pending(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    return delivery.pending(rows, "event_type", ["user_id"], "ts", 20).select("event_type", "user_id", "event_id", "batch")


@query("outbox_left", "WITH s AS (SELECT event_type, user_id, max(ts) AS sent FROM events WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 2 = 0 GROUP BY ALL) SELECT event_id FROM events e LEFT JOIN s ON e.event_type = s.event_type AND e.user_id = s.user_id WHERE sent IS NULL OR ts > sent")
def outbox_left(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    sent = e.filter((F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("user_id") % 2 == 0)).groupBy("event_type", "user_id").agg(F.max("ts").alias("ts"))
    return delivery.drained_all(e, sent, "event_type", ["user_id"], "ts").select("event_id")


@query("batch_affected", "SELECT count(*) AS asked, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS there, count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 1) AS gone FROM customer WHERE c_custkey % 2 = 0")
def batch_affected(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return delivery.affected(c.filter("c_custkey % 5 <> 1"), c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0"), ["c_custkey"])


@query("mirror_advance", "SELECT TIMESTAMP '2024-01-20' AS mark, max(ts) AS new_mark, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20') AS n, false AS refused FROM events UNION ALL SELECT TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-20', 0, true FROM region WHERE r_regionkey = 0")
def mirror_advance(spark, sf_dir):
    """A listing that goes on, and one that would go back, which is refused."""
    e, mark = table(spark, sf_dir, "events").select("ts"), spark.range(1).select(F.lit("2024-01-20").cast("timestamp_ntz").alias("ts"))
    old = e.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return delivery.advanced(e, mark, "ts").unionByName(delivery.advanced(old, mark, "ts"))


@query("retained_rows", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-23 12:00:00'")
def retained_rows(spark, sf_dir):
    return delivery.kept_since(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 7).select("event_id")


@query("redrawn_ticks", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def redrawn_ticks(spark, sf_dir):
    return delivery.redrawn(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id")


@query("markdown_table", "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || '\\|' || n_regionkey || ' |  |' AS line FROM nation")
def markdown_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumns({"label": F.concat_ws("|", "n_name", "n_regionkey"), "none": F.lit(None).cast("string")})
    return delivery.markdown_rows(n, ["n_nationkey", "label", "none"]).select("n_nationkey", "line")


@query("stage_counters", "SELECT 'read' AS stage, count(*) AS n FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'none', 0 FROM region WHERE r_regionkey = 0")
def stage_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return delivery.counters({"read": e, "users": e.select("user_id").distinct(), "none": e.filter("false")})


@query("result_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 150 OFFSET 300")
def result_page(spark, sf_dir):
    return delivery.paged(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 2, 150)


@query("spread_sample", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, event_id FROM r WHERE m <= 7 OR k IN (SELECT CAST(floor(i * m / 7) AS BIGINT) FROM range(7) t(i))")
def spread_sample(spark, sf_dir):
    return delivery.spread_sample(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 7).select("event_type", "event_id")


@query("tag_counts", "SELECT kind, value, count(DISTINCT item) AS n FROM (SELECT p_partkey AS item, 'type' AS kind, p_type AS value FROM part UNION ALL SELECT p_partkey, 'word', unnest(string_split(p_name, ' ')) FROM part) GROUP BY ALL")
def tag_counts(spark, sf_dir):
    both = F.concat(F.array(F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("value"))), F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("value"))))
    each = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.explode(both).alias("t")).select("item", "t.kind", "t.value")
    return each.groupBy("kind", "value").agg(F.count_distinct("item").alias("n"))


@query("counts_all_and_shown", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS shown, bool_or(value > 150) AS any_large, bool_and(value > 0) AS all_positive FROM events GROUP BY event_type")
def counts_all_and_shown(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v > 20).alias("shown"), F.bool_or(v > 150).alias("any_large"), F.bool_and(v > 0).alias("all_positive"))


@query("duration_spread", "SELECT l_returnflag AS flag, min(l_quantity) AS least, (list_sort(list(l_quantity)))[count(*) // 2 + 1] AS median, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY 1")
def duration_spread(spark, sf_dir):
    """Least, middle (the upper of two) and most of a value by key; the middle by counting, not by sorting a group."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    ends = rows.groupBy("flag").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return ordered.exact_medians(rows, "flag", "l_quantity").join(ends, "flag").select("flag", "least", "median", "most", "n")


@query("listed_fields", "SELECT p_partkey, '[' || string_agg(x, ',' ORDER BY k) || ']' AS flags FROM (SELECT p_partkey, unnest([1, 2, 3]) AS k, unnest([CASE WHEN p_size > 25 THEN '\"large\"' END, CASE WHEN p_retailprice > 950 THEN '\"dear\"' END, '\"' || p_type || '\"']) AS x FROM part) WHERE x IS NOT NULL GROUP BY p_partkey")
def listed_fields(spark, sf_dir):
    """Flags of a row as an ordered JSON array, those that do not hold left out."""
    flags = F.filter(F.array(F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 950, "dear"), F.col("p_type")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(flags).alias("flags"))


@query("ordered_unions", "SELECT p_brand, array_to_string(a || list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS both_lists FROM (SELECT p_brand, list(p_type ORDER BY p_partkey) AS a, list(p_name ORDER BY p_partkey) || list(p_type ORDER BY p_partkey) AS b FROM part GROUP BY p_brand)")
def ordered_unions(spark, sf_dir):
    by = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", *c))), lambda x: x[c[0]])
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(by("p_type").alias("a"), by("p_name").alias("n"))
    return lists.select("p_brand", F.array_join(aggregate.ordered_union(F.array("a", F.concat("n", "a"))), ",").alias("both_lists"))
