"""Queries of registries and forests: parts as names, nations and suppliers as entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as wording
from ..functions.text import norm, slug
from ..operators import registry
from .catalog import query, table
from .event_queries import _FOREST, _forest

_REGISTRY = """WITH names AS (SELECT 'p' || p_type AS id, lower(p_type) AS key FROM part WHERE p_type <> 'PROMO' UNION SELECT 'p' || p_type, 'kind ' || lower(p_type) FROM part WHERE p_type <> 'PROMO'),
keys AS (SELECT key, min(id) AS id FROM names GROUP BY key),
said AS (SELECT p_partkey AS item, unnest([p_type, 'Kind ' || p_type || '!', p_brand, p_type]) AS said, unnest([0, 1, 2, 3]) AS position FROM part),
found AS (SELECT item, position, said, id FROM said LEFT JOIN keys ON key = regexp_replace(lower(said), '!$', ''))
"""


def said_names(spark, sf_dir):
    """Parts as rows that name kinds in several ways, and a registry of all kinds but one."""
    p = table(spark, sf_dir, "part")
    known = p.filter("p_type <> 'PROMO'").select(F.concat(F.lit("p"), "p_type").alias("id"), F.col("p_type").alias("name"), F.array(F.concat(F.lit("KIND "), "p_type")).alias("aliases")).distinct()
    rows = p.select(F.col("p_partkey").alias("item"), F.array("p_type", F.concat(F.lit("Kind "), "p_type", F.lit("!")), "p_brand", "p_type").alias("names"))
    return rows, registry.entry_keys(known, "id", "name", "aliases", norm)


@query("tracks_resolved", _REGISTRY + "SELECT item, position, said, id FROM found")
def tracks_resolved(spark, sf_dir):
    rows, keys = said_names(spark, sf_dir)
    return registry.resolved_names(rows, "item", "names", keys, norm)


@query("people_resolved", _REGISTRY + ", f AS (SELECT item, coalesce(id, trim(regexp_replace(lower(said), '[^a-z0-9]+', '-', 'g'), '-')) AS id, min(position) AS p FROM found GROUP BY ALL) SELECT item, string_agg(id, ',' ORDER BY p) AS ids FROM f GROUP BY item")
def people_resolved(spark, sf_dir):
    rows, keys = said_names(spark, sf_dir)
    return registry.with_entries(rows, "item", "names", keys, norm, slug).withColumn("ids", F.array_join("ids", ","))


@query("unknown_names", _REGISTRY + "SELECT said, count(*) AS n FROM found WHERE id IS NULL GROUP BY said")
def unknown_names(spark, sf_dir):
    rows, keys = said_names(spark, sf_dir)
    return registry.misses(registry.resolved_names(rows, "item", "names", keys, norm))


@query("works_classified", "SELECT p_partkey, p_type AS name, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN 'w' || lower(p_type) END AS work, CASE p_type WHEN 'PROMO' THEN 'unresolved' WHEN 'SMALL' THEN 'term' ELSE 'work' END AS fate FROM part")
def works_classified(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    works = p.filter("p_type NOT IN ('PROMO', 'SMALL')").select(norm(F.col("p_type")).alias("key"), F.concat(F.lit("w"), F.lower("p_type")).alias("id")).distinct()
    return registry.classified(p.select("p_partkey", F.col("p_type").alias("name")), works, p.filter("p_type IN ('SMALL', 'LARGE')").select(norm(F.col("p_type")).alias("key")), "p_partkey", "name", norm)


_LINKS = _FOREST + """, links AS (SELECT o_orderkey AS item, 's' || (o_custkey % 10) AS node, CASE o_orderkey % 3 WHEN 0 THEN 'about' WHEN 1 THEN 'track' ELSE 'credit' END AS via FROM orders
 UNION ALL SELECT o_orderkey, 's' || (o_orderkey % 10), 'credit' FROM orders UNION ALL SELECT o_orderkey, 'n' || (o_custkey % 25), 'track' FROM orders WHERE o_orderkey % 2 = 0)
"""


def links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    link = lambda df, node, via: df.select(F.col("o_orderkey").alias("item"), node.alias("node"), via.alias("via"))
    via = F.get(F.array(F.lit("about"), F.lit("track"), F.lit("credit")), (F.col("o_orderkey") % 3).cast("int"))
    out = link(o, F.concat(F.lit("s"), F.col("o_custkey") % 10), via).unionByName(link(o, F.concat(F.lit("s"), F.col("o_orderkey") % 10), F.lit("credit")))
    return out.unionByName(link(o.filter("o_orderkey % 2 = 0"), F.concat(F.lit("n"), F.col("o_custkey") % 25), F.lit("track")))


@query("best_links", _LINKS + "SELECT item, node, arg_min(via, CASE via WHEN 'about' THEN 1 WHEN 'track' THEN 2 ELSE 3 END) AS via FROM links GROUP BY ALL")
def best_links(spark, sf_dir):
    return registry.best_links(links(spark, sf_dir), "item", "node", "via")


@query("linked_below", _LINKS + "SELECT DISTINCT item FROM links JOIN up ON up.id = node WHERE up.ancestor = 'r2' AND via IN ('about', 'track')")
def linked_below(spark, sf_dir):
    return registry.linked_below(links(spark, sf_dir), _forest(spark, sf_dir), "item", "node", "r2", ["about", "track"])


@query("cast_only", _LINKS + "SELECT DISTINCT item FROM links WHERE node = 's3' AND via = 'credit' AND item NOT IN (SELECT item FROM links WHERE node = 's3' AND via = 'about')")
def cast_only(spark, sf_dir):
    return registry.cast_only(links(spark, sf_dir), "item", "node", "s3")


@query("works_block", _LINKS + "SELECT DISTINCT ancestor AS id, f.parent FROM links JOIN up ON up.id = node LEFT JOIN (SELECT id, parent FROM forest) f ON f.id = ancestor WHERE item % 7 = 0")
def works_block(spark, sf_dir):
    return registry.block(links(spark, sf_dir).filter("item % 7 = 0"), _forest(spark, sf_dir), "node")


@query("works_outline", _FOREST.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ", path AS (SELECT id, ['r0' || id] AS p, 0 AS depth FROM forest WHERE parent IS NULL) SELECT u.id, CAST(max(u.depth) AS INTEGER) AS depth, row_number() OVER (ORDER BY list({'n': u.ancestor, 'i': u.ancestor} ORDER BY u.depth DESC)) AS r FROM up u GROUP BY u.id")
def works_outline(spark, sf_dir):
    return registry.outline(_forest(spark, sf_dir).withColumn("name", F.col("id")), "name")


@query("acyclic_links", "SELECT c_custkey AS child, CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 9 ELSE c_custkey + 1 END AS parent FROM customer WHERE c_custkey % 10 < 9 OR c_custkey % 20 = 19 AND false")
def acyclic_links(spark, sf_dir):
    """Customers in rings of ten, which lose the link of their last one."""
    k = F.col("c_custkey")
    return registry.acyclic(table(spark, sf_dir, "customer").select(k.alias("child"), F.when(k % 10 == 9, k - 9).otherwise(k + 1).alias("parent")), "child", "parent")


@query("axes_merged", "WITH x AS (SELECT p_partkey, list_slice(list_distinct_ordered, 1, 2) AS axes FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END WHEN 1 THEN [p_brand] ELSE [p_name] END AS list_distinct_ordered FROM part)) SELECT p_partkey, array_to_string(axes, ',') AS axes FROM x")
def axes_merged(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    tracks = F.get(F.array(F.array(F.array("p_type"), none, F.array("p_brand", "p_type", "p_name")), F.array(none, F.array("p_brand")), F.array(none, F.array().cast("array<string>"))), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(registry.merged_axes(tracks, F.array("p_name")), ",").alias("axes"))


@query("strongest_values", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'A') THEN 'A' END AS top, bool_or(l_linestatus = 'F') AS any_f, bool_and(l_linestatus = 'F') AS all_f FROM lineitem GROUP BY l_orderkey")
def strongest_values(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.bool_or(F.col("l_linestatus") == "F").alias("any_f"), F.bool_and(F.col("l_linestatus") == "F").alias("all_f"))
    return flags.select("l_orderkey", registry.strongest(F.col("f"), ("R", "A")).alias("top"), "any_f", "all_f")


@query("people_candidates", "WITH e AS (SELECT user_id, event_type, CAST(value AS INTEGER) % 9 AS title, event_id FROM events), n AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS roles FROM n GROUP BY 1), t AS (SELECT user_id, string_agg(title, ',' ORDER BY a) AS titles FROM (SELECT user_id, title, min(event_id) AS a FROM e GROUP BY ALL) GROUP BY 1) SELECT user_id, roles, titles FROM r JOIN t USING (user_id)")
def people_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("title", F.expr("CAST(bround(value) AS INT) % 9").cast("string"))
    found = registry.candidates(e, "user_id", "event_type", "title", "event_id")
    return found.select("user_id", F.array_join(F.transform("roles", lambda x: F.concat_ws(":", x["event_type"], x["n"].cast("string"))), ",").alias("roles"), F.array_join("titles", ",").alias("titles"))


@query("neither_listed", "SELECT DISTINCT user_id FROM events WHERE user_id % 4 <> 1 AND user_id % 6 <> 2")
def neither_listed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    return e.join(e.filter("user_id % 4 = 1"), "user_id", "left_anti").join(e.filter("user_id % 6 = 2"), "user_id", "left_anti")


@query("got_or_created", "SELECT DISTINCT lower(p_type) AS key, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'new-' || lower(p_type) ELSE 'k' || lower(p_type) END AS id, p_type IN ('PROMO', 'SMALL') AS created FROM part")
def got_or_created(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.filter("p_type NOT IN ('PROMO', 'SMALL')").select(F.lower("p_type").alias("key"), F.concat(F.lit("k"), F.lower("p_type")).alias("id")).distinct()
    return registry.got_or_created(p, known, norm(F.col("p_type")))


@query("left_unsaid", r"SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(text, '\$') AND lang = 'en' THEN 'paid' END, CASE WHEN contains(text, 'license') AND source IS NOT NULL AND n_chars % 2 = 0 THEN 'licensed' END], lambda x: x IS NOT NULL)) AS rule FROM documents) GROUP BY rule")
def left_unsaid(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = {"paid": (F.col("text").rlike(r"\$"), F.when(F.col("lang") != "en", 1)), "licensed": (F.col("text").contains("license"), F.when((F.col("n_chars") % 2 != 0) | F.col("source").isNull(), 1))}
    return registry.left_unsaid(d, "doc_id", rules)


@query("readings_disagree", "SELECT o_orderstatus AS one, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS other, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL")
def readings_disagree(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return registry.disagreeing(o, o.withColumn("v", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("v"))), ["o_orderkey"], "v")


@query("short_names", "WITH n AS (SELECT p_brand, p_partkey, 'Hall ' || p_brand || ' ' || p_name AS name FROM part) SELECT p_partkey, substr(name, length('Hall ' || p_brand) + 2) AS short FROM n")
def short_names(spark, sf_dir):
    """Names without the leading words that all of a brand share: at every place the least and greatest word must be one."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", F.lit("Hall"), "p_brand", "p_name").alias("name"))
    each = p.select("p_brand", F.posexplode(F.split("name", " ")).alias("k", "w")).groupBy("p_brand", "k").agg((F.min("w") == F.max("w")).alias("same"))
    w = Window.partitionBy("p_brand").orderBy("k")
    shared = each.withColumn("run", F.min(F.col("same").cast("int")).over(w)).groupBy("p_brand").agg(F.sum("run").cast("int").alias("shared"))
    return p.join(shared, "p_brand").select("p_partkey", wording.short_words(F.col("name"), F.least("shared", F.lit(2))).alias("short"))
