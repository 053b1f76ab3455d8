"""Queries over whole orders: places, values as of uneven slots, medians, longest keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, search
from .catalog import query, table


@query("order_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders")
def order_places(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ordered.numbered(o, [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "r")


@query("as_of_uneven_slots", "WITH s AS (SELECT ts AS slot, max(event_id) AS run FROM events WHERE event_type = 'signup' GROUP BY ts) SELECT e.event_id, s.run AS as_of_run FROM events e ASOF LEFT JOIN s ON e.ts >= s.slot")
def as_of_uneven_slots(spark, sf_dir):
    """All events on the slots that sign-ups open: one key holds every row, and slots are as uneven as they come."""
    e = table(spark, sf_dir, "events")
    slots = e.filter("event_type = 'signup'").select(F.col("ts").alias("slot"), F.col("event_id").alias("run"), F.col("event_id").alias("tie"))
    return ordered.as_of(e.select("event_id", "ts"), slots, [], "ts", "slot", "run", "tie").select("event_id", "as_of_run")


@query("as_of_slots_by_kind", "WITH s AS (SELECT user_id, ts AS slot, max(event_id) AS run FROM events WHERE value > 100 GROUP BY ALL) SELECT e.event_id, s.run AS as_of_run FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.slot")
def as_of_slots_by_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    slots = e.filter("value > 100").select("user_id", F.col("ts").alias("slot"), F.col("event_id").alias("run"), F.col("event_id").alias("tie"))
    return ordered.as_of(e.select("event_id", "user_id", "ts"), slots, ["user_id"], "ts", "slot", "run", "tie").select("event_id", "as_of_run")


@query("exact_medians", "WITH r AS (SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT flag, v AS median, n FROM r WHERE r = n // 2 + 1")
def exact_medians(spark, sf_dir):
    return ordered.exact_medians(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_extendedprice")


@query("longest_keys", "WITH k AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS k FROM part WHERE p_partkey % 3 > 0 UNION SELECT DISTINCT lower(p_name) FROM part WHERE p_partkey % 5 = 0), b AS (SELECT p_partkey, p_name, (SELECT arg_max(k, length(k)) FROM k WHERE lower(p_name) = k OR starts_with(lower(p_name), k || ' ')) AS key FROM part) SELECT p_partkey, key, CASE WHEN key IS NULL THEN p_name ELSE ltrim(substr(p_name, length(key) + 1)) END AS rest FROM b")
def longest_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keys = p.filter("p_partkey % 3 > 0").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("k")).union(p.filter("p_partkey % 5 = 0").select(F.lower("p_name")))
    return search.longest_key(p.select("p_partkey", "p_name"), "p_name", keys, "k").select("p_partkey", "key", "rest")
