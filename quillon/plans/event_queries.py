"""Interval, window, as-of and change queries over events, orders and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as times
from ..operators import cdc, hierarchy, interval
from .catalog import query, table
from .schedule_queries import DIFF_FIELDS, _EDITS, order_versions

_SPANS = "WITH spans AS (SELECT event_id, user_id, ts AS s, ts + to_minutes(CAST(1 + CAST(floor(abs(value)) AS BIGINT) % 90 AS INTEGER)) AS e FROM events)\n"


def spans(spark, sf_dir):
    """Events as intervals of 1 to 90 minutes."""
    minutes = 1 + F.floor(F.abs("value")) % 90
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))).alias("e"))


@query(
    "cause_attribution",
    _EDITS
    + """
, counter AS (SELECT id, CASE WHEN id % 46 = 3 THEN 'X' ELSE status END AS status, priority FROM prev)
, lines AS (SELECT coalesce(p.id, c.id) AS id, k.kind FROM prev p FULL JOIN cur c ON p.id = c.id CROSS JOIN (VALUES ('added'), ('removed'), ('status'), ('priority')) k(kind)
  WHERE (k.kind = 'added' AND p.id IS NULL) OR (k.kind = 'removed' AND c.id IS NULL)
   OR (p.id IS NOT NULL AND c.id IS NOT NULL AND ((k.kind = 'status' AND p.status IS DISTINCT FROM c.status) OR (k.kind = 'priority' AND p.priority IS DISTINCT FROM c.priority))))
SELECT l.kind, CASE WHEN (l.kind = 'added' AND a.id IS NOT NULL) OR (l.kind = 'removed' AND a.id IS NULL) OR (l.kind = 'status' AND a.id IS NOT NULL AND a.status IS NOT DISTINCT FROM c.status)
   OR (l.kind = 'priority' AND a.id IS NOT NULL AND a.priority IS NOT DISTINCT FROM c.priority) THEN 'code' ELSE 'source' END AS cause, count(*) AS n
FROM lines l LEFT JOIN counter a ON l.id = a.id LEFT JOIN cur c ON l.id = c.id GROUP BY ALL
""",
)
def cause_attribution(spark, sf_dir):
    previous, current = order_versions(spark, sf_dir)
    counter = previous.withColumn("status", F.when(F.col("id") % 46 == 3, "X").otherwise(F.col("status")))
    lines = cdc.snapshot_diff(previous, current, "id", DIFF_FIELDS)
    return cdc.attribute_cause(lines, counter, current, "id", DIFF_FIELDS).groupBy("kind", "cause").agg(F.count("*").alias("n"))


@query(
    "carry_forward",
    """
WITH prev AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 7 <> 1), listed AS (SELECT p_partkey AS id, upper(p_name) AS name, p_partkey % 11 = 0 AS failed FROM part WHERE p_partkey % 5 <> 2)
SELECT coalesce(p.id, l.id) AS id, CASE WHEN l.id IS NULL OR l.failed THEN p.name ELSE l.name END AS name, CASE WHEN l.id IS NULL THEN 'removed' WHEN l.failed THEN 'stale' ELSE 'fresh' END AS state
FROM prev p FULL JOIN listed l ON p.id = l.id WHERE l.id IS NULL OR NOT l.failed OR p.id IS NOT NULL
""",
)
def carry_forward(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return cdc.carry_forward(part.filter("id % 7 <> 1"), part.filter("id % 5 <> 2").withColumn("name", F.upper("name")), "id", F.col("id") % 11 == 0)


@query("latest_stamp_wins", "SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, -event_id)) AS event_id FROM events GROUP BY ALL")
def latest_stamp_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return cdc.latest_stamp_wins(rows, ["user_id", "event_type"], "ts", tie=["event_id"])


@query(
    "clamped_upsert",
    "SELECT user_id, least(max(ts), TIMESTAMP '2024-01-20 00:05:00') AS ts, arg_max(event_id, (least(ts, TIMESTAMP '2024-01-20 00:05:00'), -event_id)) AS event_id FROM events GROUP BY user_id",
)
def clamped_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return cdc.latest_stamp_wins(rows, ["user_id"], "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), tie=["event_id"])


@query("upsert_and_delete", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 9 <> 2 UNION ALL SELECT c_custkey, 'new ' || c_name, c_acctbal FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 9 <> 2")
def upsert_and_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    fresh = c.filter("c_custkey % 4 = 1").withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    return cdc.delete_keys(cdc.upsert(c, fresh, ["c_custkey"]), c.filter("c_custkey % 9 = 2"), ["c_custkey"])


@query(
    "overlap_pairs",
    _SPANS
    + "SELECT a.user_id, a.event_id AS a, b.event_id AS b, (epoch_us(least(a.e, b.e)) - epoch_us(b.s)) // 1000000 AS seconds FROM spans a JOIN spans b ON a.user_id = b.user_id AND b.s < a.e AND (a.s < b.s OR (a.s = b.s AND a.event_id < b.event_id))",
)
def overlap_pairs(spark, sf_dir):
    return interval.overlap_pairs(spans(spark, sf_dir), "user_id", "event_id", "s", "e")


@query(
    "overlap_islands",
    _SPANS
    + """, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(s) AS s, max(e) AS e FROM i GROUP BY ALL""",
)
def overlap_islands(spark, sf_dir):
    return interval.islands(spans(spark, sf_dir), "user_id", "s", "e", "event_id").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))


@query(
    "peak_concurrency",
    _SPANS
    + """, edges AS (SELECT user_id, s AS t, 1 AS d FROM spans UNION ALL SELECT user_id, e, -1 FROM spans), sums AS (SELECT user_id, t, sum(d) AS d FROM edges GROUP BY ALL),
o AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS open FROM sums)
SELECT user_id, CAST(max(open) AS BIGINT) AS peak FROM o GROUP BY user_id""",
)
def peak_concurrency(spark, sf_dir):
    return interval.peak_concurrency(spans(spark, sf_dir), "user_id", "s", "e")


@query(
    "connection_band",
    _SPANS
    + """, w AS (SELECT a, b, 4 + 2 * a + 3 * b AS walk FROM range(5) x(a), range(5) y(b) WHERE a < b AND (a + b) % 3 <> 0),
n AS (SELECT user_id, event_id, s, event_id % 5 AS here, lag(event_id % 5) OVER (PARTITION BY user_id ORDER BY s, event_id) AS there, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS prev_e FROM spans),
g AS (SELECT user_id, event_id, floor((epoch_us(s) - epoch_us(prev_e)) / 60000000) AS gap, CASE WHEN here = there THEN 0 ELSE coalesce(walk, 12) END AS walk FROM n LEFT JOIN w ON w.a = least(here, there) AND w.b = greatest(here, there) WHERE prev_e IS NOT NULL)
SELECT user_id, event_id, CAST(gap AS BIGINT) AS gap, CAST(walk AS BIGINT) AS walk, CASE WHEN gap < 0 THEN 'overlap' WHEN gap < walk THEN 'cant' WHEN gap < walk + 10 THEN 'tight' END AS band FROM g""",
)
def connection_band(spark, sf_dir):
    """From one session to the next: the gap against the walk between their buildings, 12 minutes where no walk is known."""
    walks = spark.range(25).selectExpr("id div 5 AS wa", "id % 5 AS wb").filter("wa < wb AND (wa + wb) % 3 <> 0").selectExpr("wa", "wb", "4 + 2 * wa + 3 * wb AS walk")
    placed = spans(spark, sf_dir).withColumn("here", (F.col("event_id") % 5).cast("long"))
    near = interval.with_neighbours(placed, ["user_id"], "s", "event_id", ["e", "here"]).filter("prev_e IS NOT NULL")
    walked = interval.symmetric_lookup(near, walks.withColumnsRenamed({"wa": "here", "wb": "prev_here"}), "here", "prev_here", "walk", 12)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = F.floor((micros("s") - micros("prev_e")) / 60_000_000).cast("bigint")
    return walked.select("user_id", "event_id", gap.alias("gap"), F.col("walk").cast("long").alias("walk"), interval.connection(gap, F.col("walk")).alias("band"))


@query(
    "prev_next_in_con_day",
    "WITH d AS (SELECT *, CAST(ts - INTERVAL 5 HOUR AS DATE) AS con_day FROM events) SELECT event_id, con_day, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id FROM d WINDOW w AS (PARTITION BY user_id, con_day ORDER BY ts, event_id)",
)
def prev_next_in_con_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("con_day", times.con_day(F.col("ts")))
    return interval.with_neighbours(e, ["user_id", "con_day"], "ts", "event_id", ["event_id"]).select("event_id", "con_day", "prev_event_id", "next_event_id")


@query(
    "as_of_previous",
    """
WITH r AS (SELECT * FROM events WHERE event_type = 'purchase'), l AS (SELECT * FROM events WHERE event_type <> 'purchase')
SELECT l.event_id, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS as_of_purchase FROM l
""",
)
def as_of_previous(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return interval.as_of(e.filter("event_type <> 'purchase'"), right, ["user_id"], "ts", "ts", "purchase", "purchase").select("event_id", "as_of_purchase")


@query("as_of_slot", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS slot, count(*) AS n FROM events GROUP BY ALL")
def as_of_slot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").start.cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"))


@query("time_bands", "WITH h AS (SELECT CASE WHEN hour(ts) < 5 THEN hour(ts) + 24 ELSE hour(ts) END AS h FROM events) SELECT CASE WHEN h < 12 THEN 'morning' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'evening' ELSE 'night' END AS band, count(*) AS n FROM h GROUP BY ALL")
def time_bands(spark, sf_dir):
    h = times.band_hour(F.col("ts"))
    band = F.when(h < 12, "morning").when(h < 17, "afternoon").when(h < 21, "evening").otherwise("night")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    "value_stretches",
    """
WITH x AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n FROM r GROUP BY user_id, run, event_type
""",
)
def value_stretches(spark, sf_dir):
    return interval.stretches(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(
    "walk_lookup",
    """
WITH walk AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(5 + (a.n_nationkey * 7 + b.n_nationkey) % 20 AS INTEGER) AS minutes FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 3 = 0)
SELECT x.n_nationkey AS a, y.n_nationkey AS b, CASE WHEN x.n_nationkey = y.n_nationkey THEN 0 ELSE coalesce(w.minutes, 15) END AS minutes
FROM nation x CROSS JOIN nation y LEFT JOIN walk w ON w.a = least(x.n_nationkey, y.n_nationkey) AND w.b = greatest(x.n_nationkey, y.n_nationkey) WHERE (x.n_nationkey + y.n_nationkey) % 2 = 0
""",
)
def walk_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    pairs = n.join(n.select(F.col("a").alias("b")), (F.col("a") + F.col("b")) % 2 == 0)  # 25 nations
    walk = n.join(n.select(F.col("a").alias("b")), (F.col("a") < F.col("b")) & ((F.col("a") + F.col("b")) % 3 == 0)).withColumn("minutes", (5 + (F.col("a") * 7 + F.col("b")) % 20).cast("int"))
    return interval.symmetric_lookup(pairs, walk, "a", "b", "minutes", 15)


def _forest(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return region.unionByName(nation).unionByName(supplier)


_FOREST = """WITH RECURSIVE forest AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up AS (SELECT id, id AS ancestor, 0 AS depth FROM forest UNION ALL SELECT up.id, f.parent, up.depth + 1 FROM up JOIN forest f ON f.id = up.ancestor WHERE f.parent IS NOT NULL)
"""


@query("ancestor_closure", _FOREST + "SELECT id, ancestor, depth FROM up")
def ancestor_closure(spark, sf_dir):
    return hierarchy.closure(_forest(spark, sf_dir))


@query("ancestor_counts", _FOREST + "SELECT ancestor AS node, count(DISTINCT ps) AS n FROM (SELECT l_orderkey AS ps, 's' || l_suppkey AS id FROM lineitem) x JOIN up USING (id) GROUP BY ancestor")
def ancestor_counts(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.concat(F.lit("s"), "l_suppkey").alias("node"))
    return hierarchy.rolled_up(facts, hierarchy.closure(_forest(spark, sf_dir)), "node", "order")


@query(
    "most_specific_links",
    _FOREST
    + """, links AS (SELECT DISTINCT o_orderkey AS item, 's' || (1 + o_orderkey % (SELECT count(*) FROM supplier)) AS node FROM orders UNION SELECT o_orderkey, 'n' || (o_custkey % 25) FROM orders UNION SELECT o_orderkey, 'r' || (o_custkey % 5) FROM orders)
SELECT item, node FROM links l WHERE NOT EXISTS (SELECT 1 FROM links k JOIN up ON up.id = k.node AND up.depth > 0 WHERE k.item = l.item AND up.ancestor = l.node)""",
)
def most_specific_links(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").count()
    nodes = F.explode(F.array(F.concat(F.lit("s"), 1 + F.col("o_orderkey") % suppliers), F.concat(F.lit("n"), F.col("o_custkey") % 25), F.concat(F.lit("r"), F.col("o_custkey") % 5)))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), nodes.alias("node")).distinct()
    return hierarchy.most_specific(links, hierarchy.closure(_forest(spark, sf_dir)), "item", "node")


@query(
    "merge_chains",
    "WITH RECURSIVE l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (ORDER BY o_orderkey) END AS into_id FROM orders), up AS (SELECT id, id AS survivor, 0 AS d FROM l UNION ALL SELECT up.id, l.into_id, d + 1 FROM up JOIN l ON l.id = up.survivor WHERE l.into_id IS NOT NULL) SELECT id, arg_max(survivor, d) AS survivor FROM up GROUP BY id",
)
def merge_chains(spark, sf_dir):
    return hierarchy.resolved(_ledger(table(spark, sf_dir, "orders")))


def _ledger(orders, span=1024):
    """Orders as a ledger (id, merged_into): every third key is merged into the key before it. Keys are ordered within spans;
    a span's first key follows the last one of the span before it that has any, of which there is a row a span."""
    o = orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / span).alias("span"))
    last = o.groupBy("span").agg(F.max("id").alias("last"))
    carried = last.select("span", F.lag("last").over(Window.orderBy("span")).alias("carried"))
    before = F.lag("id").over(Window.partitionBy("span").orderBy("id"))
    return o.withColumn("before", before).join(carried, "span").select("id", F.when(F.col("id") % 3 == 0, F.coalesce("before", "carried")).alias("merged_into"))


@query(
    "due_batch",
    """
WITH due AS (SELECT 'soon' AS kind, user_id, event_id, ts AS moment FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' AND ts <= TIMESTAMP '2024-01-10 18:00:00'
 UNION ALL SELECT 'changed', user_id, event_id, ts FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00'),
waiting AS (SELECT * FROM due d WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = d.user_id) AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'click' AND s.user_id = d.user_id AND s.ts > TIMESTAMP '2024-01-10 11:00:00' AND s.ts <= TIMESTAMP '2024-01-10 12:00:00')),
placed AS (SELECT *, dense_rank() OVER (ORDER BY kind, moment, user_id) AS batch, count(*) OVER (ORDER BY kind, moment, user_id) AS upto FROM waiting)
SELECT kind, user_id, event_id, moment, batch, upto FROM placed WHERE upto <= 200 OR batch = 1
""",
)
def due_batch(spark, sf_dir):
    """Notification rows that are due: two kinds, subscribed users, not told just now, whole groups up to 200 rows."""
    e = table(spark, sf_dir, "events")
    between = lambda a, b: (F.col("ts") > F.lit(a).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(b).cast("timestamp_ntz"))
    row = lambda kind, df: df.select(F.lit(kind).alias("kind"), "user_id", "event_id", F.col("ts").alias("moment"))
    due = row("soon", e.filter(between("2024-01-10 12:00:00", "2024-01-10 18:00:00"))).unionByName(row("changed", e.filter((F.col("event_type") == "error") & between("2024-01-10 06:00:00", "2024-01-10 12:00:00"))))
    told = e.filter((F.col("event_type") == "click") & between("2024-01-10 11:00:00", "2024-01-10 12:00:00")).select("user_id")
    waiting = due.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").join(told, "user_id", "left_anti")
    order = Window.orderBy("kind", "moment", "user_id")  # one batch: what fell due within the horizon
    placed = waiting.withColumns({"batch": F.dense_rank().over(order).cast("bigint"), "upto": F.count("*").over(order)})
    return placed.filter("upto <= 200 OR batch = 1").select("kind", "user_id", "event_id", "moment", "batch", "upto")


@query(
    "pick_reconcile",
    """
WITH was AS (SELECT o_orderkey AS id, o_orderdate AS at, o_orderpriority AS room FROM orders WHERE o_orderkey % 3 = 0), now_ AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS at, CASE WHEN o_orderkey % 14 = 1 THEN 'X' ELSE o_orderpriority END AS room, o_orderkey % 22 = 1 AS cancelled FROM orders WHERE o_orderkey % 6 <> 0)
SELECT w.id, CASE WHEN n.id IS NULL THEN 'gone' WHEN n.cancelled THEN 'cancelled' WHEN w.at <> n.at THEN 'moved' ELSE 'room' END AS kind FROM was w LEFT JOIN now_ n ON w.id = n.id WHERE n.id IS NULL OR n.cancelled OR w.at <> n.at OR w.room IS DISTINCT FROM n.room
""",
)
def pick_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("room"))
    now = o.filter("id % 6 <> 0").withColumns({"at": F.when(F.col("id") % 10 == 1, F.col("at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("at")), "room": F.when(F.col("id") % 14 == 1, "X").otherwise(F.col("room"))}).withColumn("cancelled", F.col("id") % 22 == 1)
    return cdc.reconcile(o.filter("id % 3 = 0"), now, "id", "at", "room", "cancelled")


@query(
    "watermark_pull",
    "SELECT event_id, user_id, ts FROM events WHERE ts > (SELECT max(ts) - INTERVAL 60 SECOND FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00')",
)
def watermark_pull(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return cdc.changed_since(e, e.filter("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "ts", "60 seconds")


@query(
    "returns_after_gap",
    "WITH v AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS version FROM events WHERE event_type = 'click'), n AS (SELECT *, lead(version) OVER (PARTITION BY user_id ORDER BY version) AS next FROM v) SELECT user_id, version AS left_after, next AS back_in, next - version - 1 AS missing FROM n WHERE next - version > 1",
)
def returns_after_gap(spark, sf_dir):
    seen = table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("version")).distinct()
    after = seen.withColumn("back_in", F.lead("version").over(Window.partitionBy("user_id").orderBy("version")))
    return after.filter("back_in - version > 1").select("user_id", F.col("version").alias("left_after"), "back_in", (F.col("back_in") - F.col("version") - 1).alias("missing"))
