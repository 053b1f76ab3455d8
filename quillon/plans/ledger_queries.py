"""Queries of the identity ledger and of changes between versions, over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, identity, ledger
from .catalog import query, table

_LISTED = """WITH ledger AS (SELECT o_orderkey AS source, CAST(min(o_orderkey) OVER (PARTITION BY o_custkey) AS VARCHAR) AS id, 'k' || o_custkey AS last_key FROM orders WHERE o_orderkey % 11 <> 4),
listed AS (SELECT o_orderkey AS source, 'k' || CASE WHEN o_orderkey % 17 = 3 OR o_custkey % 10 = 9 THEN o_custkey + 1 ELSE o_custkey END AS key, o_orderkey % 29 <> 6 AS live FROM orders WHERE o_custkey % 13 <> 5 OR o_orderkey % 11 = 4),
claims AS (SELECT id, key, count(*) AS size, max(CAST(key = last_key AS INTEGER)) AS same, min(source) AS low FROM listed JOIN ledger USING (source) WHERE live GROUP BY ALL),
won AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY id ORDER BY size DESC, same DESC, low) = 1),
kept AS (SELECT key, min(id) AS id FROM won GROUP BY key),
gone AS (SELECT last_key AS key, min(id) AS back FROM ledger WHERE id NOT IN (SELECT id FROM claims) GROUP BY 1),
given AS (SELECT g.key, coalesce(kept.id, gone.back, CASE WHEN CAST(low AS VARCHAR) IN (SELECT id FROM ledger) THEN low || '.1' ELSE CAST(low AS VARCHAR) END) AS id,
  CASE WHEN kept.id IS NOT NULL THEN 'kept' WHEN gone.back IS NOT NULL THEN 'back' ELSE 'new' END AS how
  FROM (SELECT key, min(source) AS low FROM listed WHERE live GROUP BY key) g LEFT JOIN kept ON g.key = kept.key LEFT JOIN gone ON g.key = gone.key),
mapped AS (SELECT source, given.id FROM listed JOIN given USING (key) WHERE live UNION ALL SELECT source, ledger.id FROM listed JOIN ledger USING (source) WHERE NOT live)
"""


def listed(spark, sf_dir):
    """Orders as a listing (source, key, live) and the ledger (source, id, last_key) before it: by rule some sources moved to
    another key, are new, are not live, or have gone with all of their line."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("c"))
    known = o.filter("source % 11 <> 4")
    lines = known.groupBy("c").agg(F.min("source").cast("string").alias("id"))
    key = F.concat(F.lit("k"), F.when((F.col("source") % 17 == 3) | (F.col("c") % 10 == 9), F.col("c") + 1).otherwise(F.col("c")))
    rows = o.filter("c % 13 <> 5 OR source % 11 = 4").select("source", key.alias("key"), (F.col("source") % 29 != 6).alias("live"))
    return rows, known.join(lines, "c").select("source", "id", F.concat(F.lit("k"), F.col("c")).alias("last_key"))


@query("ledger_groups", _LISTED + "SELECT key, id, how FROM given")
def ledger_groups(spark, sf_dir):
    return ledger.assign(*listed(spark, sf_dir))


@query("ledger_sources", _LISTED + "SELECT m.source, m.id, CASE WHEN l.id <> m.id THEN l.id END AS moved_from FROM mapped m LEFT JOIN ledger l USING (source)")
def ledger_sources(spark, sf_dir):
    return ledger.mapped(*listed(spark, sf_dir))


@query("ledger_merges", _LISTED + "SELECT won.id, kept.id AS merged_into FROM won JOIN kept USING (key) WHERE won.id <> kept.id")
def ledger_merges(spark, sf_dir):
    return ledger.merges(*listed(spark, sf_dir))


@query(
    "ledger_bookkeeping",
    _LISTED
    + """, lines AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS gone_since FROM (SELECT DISTINCT id FROM ledger)),
alive AS (SELECT DISTINCT mapped.id FROM mapped JOIN listed USING (source) WHERE live)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM alive) THEN coalesce(gone_since, TIMESTAMP '2024-06-01 00:00:00') END AS gone_since, id IN (SELECT id FROM alive) AND gone_since IS NOT NULL AS returned FROM lines""",
)
def ledger_bookkeeping(spark, sf_dir):
    rows, known = listed(spark, sf_dir)
    lines = known.select("id").distinct().withColumn("gone_since", F.when(F.col("id").cast("long") % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    return ledger.bookkeeping(lines, rows, known, "2024-06-01 00:00:00")


@query("ledger_again", _LISTED + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS moved FROM mapped")
def ledger_again(spark, sf_dir):
    """A second pass over the ledger that the first one leaves: rows, and those that got another id (none)."""
    rows, known = listed(spark, sf_dir)
    return ledger.mapped(rows, ledger.next_ledger(rows, known)).agg(F.count("*").alias("n"), F.count("moved_from").alias("moved"))


@query("ledger_replay", _LISTED + "SELECT v.version, source, id FROM mapped, (VALUES (0), (1)) v(version)")
def ledger_replay(spark, sf_dir):
    """Two versions of the same listing: the second one finds its ids in the ledger that the first one left."""
    rows, known = listed(spark, sf_dir)
    return ledger.replay([rows, rows], known)


@query(
    "unsure_pairs",
    """
WITH p AS (SELECT s_suppkey AS id, s_nationkey AS title, CAST(round(s_acctbal) AS BIGINT) % 40 AS start, regexp_replace(lower('Room ' || (s_suppkey % 50)), '[^a-z0-9]+', '', 'g') AS place FROM supplier),
c AS (SELECT id, CASE WHEN id % 3 = 0 THEN -1 ELSE title END AS title, start, CASE WHEN id % 5 = 0 THEN 'room0' ELSE place END AS place FROM p)
SELECT p.id AS gone, c.id AS new FROM p JOIN c ON CAST(p.title = c.title AS INTEGER) + CAST(p.start = c.start AS INTEGER) + CAST(p.place = c.place AS INTEGER) >= 2
""",
)
def unsure_pairs(spark, sf_dir):
    """Lines that may be the same ones under new ids: two of title, start and folded place agree."""
    folded = F.regexp_replace(F.lower(F.concat(F.lit("Room "), (F.col("s_suppkey") % 50).cast("string"))), "[^a-z0-9]+", "")
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("title"), (F.round("s_acctbal").cast("long") % 40).alias("start"), folded.alias("place"))
    c = p.withColumns({"title": F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("title")), "place": F.when(F.col("id") % 5 == 0, "room0").otherwise(F.col("place"))})
    return identity.two_of_three(p, c, "id", ["title", "start", "place"])


_VERSIONS = """WITH prev AS (SELECT o_orderkey AS id, o_orderkey % 19 = 2 AS removed, o_orderkey % 23 = 1 AS cancelled, o_orderdate AS at, o_orderpriority AS place, o_orderstatus AS title, o_custkey AS description,
  [o_orderstatus, o_orderpriority] AS people, [o_orderstatus] AS tracks, CASE WHEN o_orderkey % 41 = 0 THEN ['a'] ELSE [] END AS was FROM orders WHERE o_orderkey % 101 <> 7),
cur AS (SELECT o_orderkey AS id, o_orderkey % 19 = 2 AND o_orderkey % 3 > 0 OR o_orderkey % 31 = 5 AS removed, o_orderkey % 23 IN (1, 4) AND o_orderkey % 7 > 1 AS cancelled, CASE WHEN o_orderkey % 13 = 6 THEN o_orderdate + INTERVAL 1 HOUR ELSE o_orderdate END AS at,
  CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE o_orderpriority END AS place, CASE WHEN o_orderkey % 43 = 3 THEN 'X' ELSE o_orderstatus END AS title, o_custkey + CAST(o_orderkey % 53 = 8 AS INTEGER) AS description,
  CASE WHEN o_orderkey % 5 = 1 THEN [o_orderpriority, o_orderstatus, o_orderstatus] ELSE [o_orderstatus, o_orderpriority] END AS people, CASE WHEN o_orderkey % 59 = 9 THEN [o_orderstatus, 'T'] ELSE [o_orderstatus] END AS tracks,
  CASE WHEN o_orderkey % 41 IN (0, 1) THEN ['a'] ELSE [] END AS was FROM orders WHERE o_orderkey % 103 <> 9)
"""


def listing_versions(spark, sf_dir):
    """Two versions of a listing made from orders, with edits of every kind by rule."""
    k = F.col("o_orderkey")
    strings = F.array().cast("array<string>")
    o = table(spark, sf_dir, "orders")
    same = {"at": F.col("o_orderdate"), "place": F.col("o_orderpriority"), "title": F.col("o_orderstatus"), "description": F.col("o_custkey"), "people": F.array("o_orderstatus", "o_orderpriority"), "tracks": F.array("o_orderstatus")}
    before = same | {"removed": k % 19 == 2, "cancelled": k % 23 == 1, "was": F.when(k % 41 == 0, F.array(F.lit("a"))).otherwise(strings)}
    after = {
        "removed": (k % 19 == 2) & (k % 3 > 0) | (k % 31 == 5), "cancelled": (k % 23).isin(1, 4) & (k % 7 > 1), "at": F.when(k % 13 == 6, same["at"] + F.expr("INTERVAL 1 HOUR")).otherwise(same["at"]),
        "place": F.when(k % 37 != 5, same["place"]), "title": F.when(k % 43 == 3, "X").otherwise(same["title"]), "description": same["description"] + (k % 53 == 8).cast("int"),
        "people": F.when(k % 5 == 1, F.array("o_orderpriority", "o_orderstatus", "o_orderstatus")).otherwise(same["people"]), "tracks": F.when(k % 59 == 9, F.array("o_orderstatus", F.lit("T"))).otherwise(same["tracks"]),
        "was": F.when((k % 41).isin(0, 1), F.array(F.lit("a"))).otherwise(strings),
    }
    made = lambda df, columns: df.select(k.alias("id"), *[v.alias(c) for c, v in columns.items()])
    return made(o.filter(k % 101 != 7), before), made(o.filter(k % 103 != 9), after)


@query(
    "change_kinds",
    _VERSIONS
    + """, b AS (SELECT coalesce(p.id, c.id) AS id, p, c, c.id IS NOT NULL AND NOT c.removed AS here, p.id IS NOT NULL AND NOT p.removed AS there FROM prev p FULL JOIN cur c ON p.id = c.id)
SELECT id, kind FROM (SELECT id, unnest(list_filter([CASE WHEN here AND p.id IS NULL THEN 'added' END, CASE WHEN there AND NOT coalesce(here, false) THEN 'removed' END, CASE WHEN here AND p.removed THEN 'restored' END,
 CASE WHEN here AND there AND c.cancelled AND NOT p.cancelled THEN 'cancelled' END, CASE WHEN here AND there AND p.cancelled AND NOT c.cancelled THEN 'uncancelled' END,
 CASE WHEN here AND there AND p.at IS DISTINCT FROM c.at THEN 'time' END, CASE WHEN here AND there AND p.place IS DISTINCT FROM c.place THEN 'place' END, CASE WHEN here AND there AND p.title IS DISTINCT FROM c.title THEN 'title' END,
 CASE WHEN here AND there AND p.description IS DISTINCT FROM c.description THEN 'description' END, CASE WHEN here AND there AND list_sort(list_distinct(p.people)) <> list_sort(list_distinct(c.people)) THEN 'people' END,
 CASE WHEN here AND there AND list_sort(list_distinct(p.tracks)) <> list_sort(list_distinct(c.tracks)) THEN 'tracks' END, CASE WHEN here AND len(c.was) > coalesce(len(p.was), 0) THEN 'merged' END], lambda x: x IS NOT NULL)) AS kind FROM b)""",
)
def change_kinds(spark, sf_dir):
    fields = {"time": "at", "place": "place", "title": "title", "description": "description"}
    return changes.change_kinds(*listing_versions(spark, sf_dir), "id", fields, {"people": "people", "tracks": "tracks"}, "removed", "cancelled", "was")


@query("vanished_ids", _VERSIONS + "SELECT id FROM prev WHERE id NOT IN (SELECT id FROM cur) AND id % 2 = 0")
def vanished_ids(spark, sf_dir):
    before, after = listing_versions(spark, sf_dir)
    return changes.vanished(before, after, before.filter("id % 2 = 1"), "id")


@query("changed_at", _VERSIONS + "SELECT c.id, CASE WHEN p.title = c.title AND p.at = c.at THEN DATE '2024-01-01' ELSE DATE '2024-02-02' END AS stamp FROM cur c LEFT JOIN prev p ON p.id = c.id")
def changed_at(spark, sf_dir):
    before, after = (df.select("id", "title", "at").withColumn("stamp", F.lit("2024-01-01").cast("date")) for df in listing_versions(spark, sf_dir))
    return changes.changed_at(before, after, "id", F.sha2(F.to_json(F.struct("title", "at")), 256), "stamp", F.lit("2024-02-02").cast("date")).select("id", "stamp")


@query("loose_matches", "WITH p AS (SELECT p_partkey AS id, lower(p_name) AS t, p_size AS s, p_brand AS r FROM part) SELECT a.id AS gone, b.id AS new, CASE WHEN a.s <> b.s AND a.r <> b.r THEN 'both' WHEN a.s <> b.s THEN 'start' WHEN a.r <> b.r THEN 'room' ELSE 'none' END AS differs FROM p a JOIN p b USING (t) WHERE a.id % 2 = 0 AND b.id % 2 = 1")
def loose_matches(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit("!"))).alias("title"), "p_size", "p_brand")
    return changes.loosely_matched(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "id", "title", "p_size", "p_brand")


_HELD = "WITH v AS (SELECT DISTINCT user_id AS key, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS version, event_type AS id FROM events)\n"


def held(spark, sf_dir):
    """Events as versions (a day each) of what a user's key held."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("version"), F.col("event_type").alias("id"))


@query("version_returns", _HELD + "SELECT key, version + 1 AS left_at, back_at FROM (SELECT *, lead(version) OVER (PARTITION BY key ORDER BY version) AS back_at FROM (SELECT DISTINCT key, version FROM v)) WHERE back_at > version + 1")
def version_returns(spark, sf_dir):
    return changes.returns(held(spark, sf_dir), "key", "version")


@query("returns_otherwise", _HELD + ", h AS (SELECT key, version, list(id) AS ids FROM v GROUP BY ALL), w AS (SELECT *, lead(version) OVER (PARTITION BY key ORDER BY version) AS back_at, lead(ids) OVER (PARTITION BY key ORDER BY version) AS then_ids FROM h) SELECT key, version + 1 AS left_at, back_at FROM w WHERE back_at > version + 1 AND NOT list_has_any(ids, then_ids)")
def returns_otherwise(spark, sf_dir):
    return changes.returned_otherwise(held(spark, sf_dir), "id", "key", "version")


@query("last_repeats", "WITH n AS (SELECT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS version, user_id FROM events GROUP BY ALL HAVING count(*) > 1) SELECT version, count(*) AS n FROM n WHERE version = (SELECT max(version) FROM n) GROUP BY version")
def last_repeats(spark, sf_dir):
    return changes.last_with_repeats(held(spark, sf_dir), "key", "version")


@query("turning_points", _HELD + ", f AS (SELECT key AS source, version, min(id) AS id FROM v GROUP BY ALL), w AS (SELECT *, lag(id) OVER (PARTITION BY source ORDER BY version) AS before, row_number() OVER (PARTITION BY source ORDER BY version) AS r FROM f) SELECT source, version, id, before FROM w WHERE r = 1 OR before <> id")
def turning_points(spark, sf_dir):
    mapped = held(spark, sf_dir).groupBy(F.col("key").alias("source"), "version").agg(F.min("id").alias("id"))
    return changes.turning_points(mapped, "source", "id", "version")


@query("code_flags", "WITH v AS (SELECT DISTINCT date_trunc('day', ts) AS moment FROM events), s AS (SELECT moment, lag(moment) OVER (ORDER BY moment) AS before FROM v) SELECT CAST(moment AS TIMESTAMP) AS moment, coalesce((SELECT bool_or(value > 150) FROM events e WHERE e.event_type = 'signup' AND (e.ts > before OR before IS NULL) AND e.ts <= moment), false) AS code_changed FROM s")
def code_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    versions = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("moment")).distinct()
    return changes.flagged(versions, e.filter("event_type = 'signup'").select(F.col("ts").alias("moment"), (F.col("value") > 150).alias("code")), "moment", "code")


@query("fail_safe_changes", "SELECT event_id, user_id AS run, coalesce((SELECT c_acctbal > 5000 FROM customer WHERE c_custkey = user_id AND c_custkey % 3 > 0), true) AS flag FROM events WHERE user_id > 7")
def fail_safe_changes(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("run"), (F.col("c_acctbal") > 5000).alias("flag"))
    return changes.fail_safe(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run")), F.lit(7), runs, "run", "flag").select("event_id", "run", "flag")


@query("change_phases", "SELECT CASE WHEN CAST(ts AS DATE) < DATE '2024-01-10' THEN 'before' WHEN CAST(ts AS DATE) > DATE '2024-01-14' THEN 'after' ELSE 'during' END AS phase, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def change_phases(spark, sf_dir):
    return changes.phases(table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"), "ts", "2024-01-10", "2024-01-14")


@query("mirror_deletes", "SELECT o_orderkey, o_orderkey % 4 <> 1 AS stray FROM orders WHERE o_orderkey % 9 = 3")
def mirror_deletes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return changes.to_delete(o, o.filter("o_orderkey % 9 <> 3"), o.filter("o_orderkey % 4 = 1"), "o_orderkey")


@query("log_appends", "SELECT event_id, CASE WHEN event_id % 97 = 5 THEN 'lost' WHEN event_id % 89 = 3 THEN 'put in' WHEN event_id % 83 = 4 THEN 'changed' END AS problem FROM events WHERE event_id < (SELECT max(event_id) FROM events) - 100 AND (event_id % 97 = 5 OR event_id % 89 = 3 OR event_id % 83 = 4) AND NOT (event_id % 97 = 5 AND event_id % 89 = 3)")
def log_appends(spark, sf_dir):
    """A log and a later version of it, which by rule has lost, changed and put in some lines, and has a hundred more."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    last = e.agg((F.max("event_id") - 100).alias("last"))
    log = e.crossJoin(F.broadcast(last)).filter("event_id < last AND event_id % 89 <> 3").drop("last")  # one row
    longer = e.filter("event_id % 97 <> 5").withColumn("event_type", F.when(F.col("event_id") % 83 == 4, "X").otherwise(F.col("event_type")))
    return changes.appended(log, longer, "event_id", ["event_id", "event_type"])


@query("worth_writing", _VERSIONS + "SELECT count(*) AS n, count(*) FILTER (WHERE p.title IS DISTINCT FROM c.title OR p.id IS NULL OR c.id IS NULL) AS differ, count(*) FILTER (WHERE p.title IS DISTINCT FROM c.title OR p.id IS NULL OR c.id IS NULL) > 0 AS write FROM prev p FULL JOIN cur c ON p.id = c.id")
def worth_writing(spark, sf_dir):
    return changes.worth_writing(*listing_versions(spark, sf_dir), "id", ["id", "title"])


@query("same_content_writes_nothing", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differ, false AS write FROM orders WHERE o_orderkey % 101 <> 7")
def same_content_writes_nothing(spark, sf_dir):
    before, _ = listing_versions(spark, sf_dir)
    return changes.worth_writing(before, before.withColumn("stamp", F.lit(1)), "id", ["id", "title", "people"])
