"""Queries over picks: merged with tombstones, days that hold one, lists dealt in turn, a log in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, picks
from .catalog import query, table

#: Stored: what a reader did with an item up to the tenth day; sent by devices: all from the eighth day on, stamps up to 40 days
#: ahead of their time. Items are events of one schedule, event_id % 200.
_NOW = "2024-01-22 12:00:00"
_PICKS = f"""WITH sent AS (SELECT user_id AS reader, event_id % 200 AS item, least(CAST(ts AS TIMESTAMP) + CASE WHEN event_id % 31 = 0 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END, TIMESTAMP '{_NOW}' + INTERVAL 5 MINUTE) AS stamp, event_id % 3 <> 0 AS picked FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-08'),
best AS (SELECT reader, item, max(stamp) AS stamp, arg_max(picked, (stamp, picked)) AS picked FROM sent GROUP BY ALL),
stored AS (SELECT user_id AS reader, event_id % 200 AS item, max(CAST(ts AS TIMESTAMP)) AS stamp, arg_max(event_id % 3 <> 0, (CAST(ts AS TIMESTAMP), event_id % 3 <> 0)) AS picked FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-10' GROUP BY ALL),
merged AS (SELECT coalesce(b.reader, s.reader) AS reader, coalesce(b.item, s.item) AS item, b.stamp IS NOT NULL AND (s.stamp IS NULL OR b.stamp > s.stamp) AS came, CASE WHEN b.stamp IS NOT NULL AND (s.stamp IS NULL OR b.stamp > s.stamp) THEN b.stamp ELSE s.stamp END AS stamp,
  CASE WHEN b.stamp IS NOT NULL AND (s.stamp IS NULL OR b.stamp > s.stamp) THEN b.picked ELSE s.picked END AS picked FROM best b FULL JOIN stored s ON b.reader = s.reader AND b.item = s.item),
schedule AS (SELECT event_id AS item, CAST(CAST(ts AS TIMESTAMP) - INTERVAL 5 HOUR AS DATE) AS day, value > 120 AS removed FROM events WHERE event_id < 200),
held AS (SELECT reader, day, count(DISTINCT item) AS n FROM merged JOIN schedule USING (item) WHERE picked AND NOT coalesce(removed, false) GROUP BY ALL)"""


def kept(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("reader"), (F.col("event_id") % 200).alias("item"), F.col("ts").cast("timestamp_ntz").alias("stamp"), (F.col("event_id") % 3 != 0).alias("picked"), "event_id")
    day = F.to_date("stamp")
    before = e.filter(day <= F.lit("2024-01-10").cast("date")).groupBy("reader", "item").agg(F.max(F.struct("stamp", "picked")).alias("r")).select("reader", "item", "r.*")
    ahead = F.when(F.col("event_id") % 31 == 0, F.col("stamp") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("stamp"))
    sent = e.filter(day >= F.lit("2024-01-08").cast("date")).withColumn("stamp", ahead)
    return picks.merged(before, sent, ["reader", "item"], "stamp", ["picked"], F.lit(_NOW).cast("timestamp_ntz"))


def held(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id < 200")
    schedule = e.select(F.col("event_id").alias("item"), F.to_date(F.col("ts").cast("timestamp_ntz") - F.expr("INTERVAL 5 HOURS")).alias("day"), (F.col("value") > 120).alias("removed"))
    return picks.held_days(kept(spark, sf_dir), schedule, "reader", "item", "day", F.col("removed"))


@query("picks_merged", _PICKS + " SELECT reader, item, stamp, picked, came FROM merged")
def picks_merged(spark, sf_dir):
    return kept(spark, sf_dir)


@query("pick_days", _PICKS + " SELECT reader, day, n FROM held")
def pick_days(spark, sf_dir):
    return held(spark, sf_dir)


@query("opening_days", _PICKS + " SELECT reader, coalesce(min(day) FILTER (day >= DATE '2024-01-05'), min(day)) AS day FROM held GROUP BY reader")
def opening_days(spark, sf_dir):
    return picks.opening_day(held(spark, sf_dir), "reader", "day", F.lit("2024-01-05").cast("date"))


@query("lists_dealt", "WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events), f AS (SELECT user_id, min(turn) AS turn, arg_min(event_type, (turn, event_type)) AS event_type FROM t GROUP BY user_id) SELECT user_id, event_type, row_number() OVER (ORDER BY turn, event_type, user_id) AS r FROM f")
def lists_dealt(spark, sf_dir):
    return picks.dealt(table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id"), "event_type", [F.col("ts"), F.col("event_id")], "user_id")


@query("log_in_order", "SELECT event_id, row_number() OVER (ORDER BY 'r' || user_id, CAST(event_id AS VARCHAR), event_type) AS line FROM events")
def log_in_order(spark, sf_dir):
    """A change log by run, id and kind, as text (10 before 9), whatever its size."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"))
    return ordered.numbered(e, [F.col("run"), F.col("id"), F.col("kind")], "line").select("event_id", "line")
