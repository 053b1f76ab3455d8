"""Counting, identity, search, recommendation and quality queries over documents, parts, events and labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregate, ordered, quality, recommend, search
from .catalog import query, table

_NORM = r"regexp_replace(lower(trim(regexp_replace({0}, '[ \t\n\r\f]+', ' ', 'g'))), '[ .,;:!?]+$', '')"
_WORDS = "regexp_extract_all(lower({0}), '([a-z0-9à-ÿ]+)')"


@query("dupe_groups", f"SELECT md5({_NORM.format('text')}) AS key, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dupe_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(text.norm(F.col("text"))).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1")


@query(
    "group_merge",
    "SELECT p_brand AS group_key, min(p_partkey) AS p_partkey, count(*) AS n, arg_min(p_type, p_partkey) AS p_type, arg_max(p_name, (length(p_name), -p_partkey)) AS p_name, (SELECT array_to_string(list(c ORDER BY k), '|') FROM (SELECT CAST(p_size AS VARCHAR) AS c, min(p_partkey) AS k FROM part q WHERE q.p_brand = part.p_brand GROUP BY 1)) AS members FROM part GROUP BY p_brand",
)
def group_merge(spark, sf_dir):
    merged = aggregate.group_merge(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_type"], "p_name", "p_size")
    return merged.withColumn("members", F.array_join(F.col("members").cast("array<string>"), "|"))


@query("ranked_counts", "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type")
def ranked_counts(spark, sf_dir):
    return aggregate.ranked_counts(table(spark, sf_dir, "events"), "event_type")


@query("histogram_buckets", "SELECT b.bucket, count(l.l_quantity) AS n FROM (VALUES (0), (1), (2), (3), (4)) b(bucket) LEFT JOIN lineitem l ON b.bucket = CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 20 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END GROUP BY 1")
def histogram_buckets(spark, sf_dir):
    return aggregate.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [5, 10, 20, 40])


@query("crosstab", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"n_F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"n_O\", count(*) AS n FROM lineitem GROUP BY 1")
def crosstab(spark, sf_dir):
    return aggregate.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("share_by_group", "SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 6) AS pct FROM documents GROUP BY source")
def share_by_group(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("pct"))


@query(
    "dominant_value",
    "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) SELECT user_id, event_type AS dominant, n, total FROM r WHERE r = 1 AND n >= total * 0.25",
)
def dominant_value(spark, sf_dir):
    return aggregate.dominant_value(table(spark, sf_dir, "events"), "user_id", "event_type", 0.25)


@query(
    "mode_with_tie",
    "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM n) SELECT user_id, min(event_type) AS winner, any_value(n) AS n, count(*) > 1 AS tie FROM m WHERE n = most GROUP BY user_id",
)
def mode_with_tie(spark, sf_dir):
    return aggregate.mode_with_tie(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("recurring_titles", "SELECT p_name, count(*) AS n, count(DISTINCT p_size) AS starts FROM part GROUP BY p_name HAVING count(DISTINCT p_size) > 1")
def recurring_titles(spark, sf_dir):
    return aggregate.recurring(table(spark, sf_dir, "part"), "p_name", "p_size")


@query(
    "field_variation",
    "WITH g AS (SELECT p_name, count(*) AS n, count(DISTINCT p_brand) > 1 AS a, count(DISTINCT p_type) > 1 AS b, count(DISTINCT p_size) > 1 AS c FROM part GROUP BY p_name HAVING count(*) > 1) SELECT p_name, n, CAST(a::INT + b::INT + c::INT AS BIGINT) AS n_varied, concat_ws(',', CASE WHEN a THEN 'p_brand' END, CASE WHEN b THEN 'p_type' END, CASE WHEN c THEN 'p_size' END) AS varied FROM g",
)
def field_variation(spark, sf_dir):
    return aggregate.varied_fields(table(spark, sf_dir, "part"), "p_name", ["p_brand", "p_type", "p_size"])


@query(
    "labels_agreement",
    "WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE toxic END AS toxic FROM labels) SELECT 'quality' AS field, count(*) AS n, count(*) FILTER (WHERE l.quality IS NOT DISTINCT FROM b.quality) AS same FROM labels l JOIN b USING (doc_id) UNION ALL SELECT 'toxic', count(*), count(*) FILTER (WHERE l.toxic IS NOT DISTINCT FROM b.toxic) FROM labels l JOIN b USING (doc_id)",
)
def labels_agreement(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    b = a.withColumns({"quality": F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.when(F.col("doc_id") % 9 != 0, F.col("toxic"))})
    return aggregate.agreement(a, b, "doc_id", ["quality", "toxic"])


@query("title_terms", f"WITH t AS (SELECT p_partkey, {_WORDS.format('p_name')} AS w FROM part), x AS (SELECT DISTINCT p_partkey, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t) SELECT term, count(*) AS df FROM x GROUP BY term")
def title_terms(spark, sf_dir):
    w = text.words(F.col("p_name"))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return aggregate.document_frequency(table(spark, sf_dir, "part"), F.concat(w, pairs), "p_partkey")


@query("upper_median", "WITH r AS (SELECT l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem) SELECT l_linestatus, l_quantity AS median, n FROM r WHERE r = n // 2 + 1")
def upper_median(spark, sf_dir):
    return ordered.exact_medians(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity")


@query("keyword_in_context", "SELECT doc_id, CASE WHEN strpos(text, 'license') > 41 THEN '…' ELSE '' END || substr(text, greatest(strpos(text, 'license') - 40, 1), least(strpos(text, 'license') + 47, length(text) + 1) - greatest(strpos(text, 'license') - 40, 1)) || CASE WHEN least(strpos(text, 'license') + 47, length(text) + 1) <= length(text) THEN '…' ELSE '' END AS context FROM documents WHERE strpos(text, 'license') > 0")
def keyword_in_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_in_context(F.col("text"), "license").alias("context")).filter("context IS NOT NULL")


@query("facets_regex", r"SELECT doc_id, regexp_matches(text, '(?i)\bcancel(l?ed)?\b') AS cancelled, regexp_matches(text, '(?i)(\$[0-9]+|\b[0-9]+ dollars\b)') AS paid, (SELECT max(CAST(x AS INTEGER)) FROM (SELECT unnest(regexp_extract_all(text, '\b([0-9]{1,2})\+', 1)) AS x)) AS min_age FROM documents")
def facets_regex(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(r"(?i)\bcancel(l?ed)?\b").alias("cancelled"), t.rlike(r"(?i)(\$[0-9]+|\b[0-9]+ dollars\b)").alias("paid"), text.largest_number(t, r"\b([0-9]{1,2})\+").alias("min_age"))


_BM25 = f"""WITH t AS (SELECT doc_id AS doc, {_WORDS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), x AS (SELECT doc, len(w) AS l, unnest(w) AS term FROM t),
tf AS (SELECT doc, l, term, count(*) AS tf FROM x WHERE term IN ('license', 'released', 'north') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT doc, count(*) AS n_terms, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))) AS score FROM tf JOIN df USING (term) CROSS JOIN s GROUP BY doc)
"""
QUERY = ["license", "released", "north"]


@query("bm25_search", _BM25 + "SELECT doc, n_terms, round(score, 6) AS score FROM b")
def bm25_search(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), QUERY).withColumn("score", F.round("score", 6))


@query("and_or_fallback", _BM25 + "SELECT doc, n_terms, round(score, 6) AS score, n_terms < 3 AS loose FROM b WHERE n_terms = 3 OR (SELECT count(*) FROM b WHERE n_terms = 3) < 8")
def and_or_fallback(spark, sf_dir):
    found = search.bm25(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), QUERY)
    return search.all_or_any(found, len(QUERY)).withColumn("score", F.round("score", 6))


@query("fuzzy_terms", f"WITH v AS (SELECT DISTINCT unnest({_WORDS.format('p_name')}) AS term FROM part), q(query, edits) AS (VALUES ('widget', 1), ('smal', 0), ('lerge', 1)), x AS (SELECT query, term, CASE WHEN term = query THEN 'exact' WHEN length(query) >= 4 AND starts_with(term, query) THEN 'prefix' WHEN edits > 0 AND levenshtein(term, query) <= edits THEN 'close' END AS how FROM v, q) SELECT * FROM x WHERE how IS NOT NULL")
def fuzzy_terms(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "part").select(F.explode(text.words(F.col("p_name"))).alias("term")).distinct()
    return search.fuzzy_terms(vocabulary, ["widget", "smal", "lerge"])


@query("suggest_names", "WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE starts_with(lower(p_type), 'st') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM n) SELECT * FROM r WHERE r <= 5")
def suggest_names(spark, sf_dir):
    return search.suggest(table(spark, sf_dir, "part"), "p_brand", "p_type", "ST")


@query("facet_counts", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'long', CAST(n_chars > 2000 AS VARCHAR), count(*) FROM documents WHERE n_chars IS NOT NULL GROUP BY 2")
def facet_counts(spark, sf_dir):
    return search.facet_counts(table(spark, sf_dir, "documents"), {"lang": F.col("lang"), "source": F.col("source"), "long": F.col("n_chars") > 2000})


@query("conjunctive_filter", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND CAST(ts - INTERVAL 5 HOUR AS DATE) = DATE '2024-01-08' AND value > 10 AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)")
def conjunctive_filter(spark, sf_dir):
    from ..functions.time import con_day

    keep = quality.all_of(F.col("event_type").isin("click", "view"), con_day(F.col("ts")) == F.lit("2024-01-08").cast("date"), F.col("value") > 10)
    even = table(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").filter(keep).join(even, "user_id", "left_semi").select("event_id", "user_id", "event_type")


@query("prefix_match_longest", "SELECT p_partkey, key, CASE WHEN key IS NULL THEN p_name ELSE ltrim(substr(p_name, length(key) + 1)) END AS rest FROM (SELECT p_partkey, p_name, (SELECT arg_max(k, length(k)) FROM (VALUES ('cold'), ('cold widget'), ('small'), ('sm')) v(k) WHERE lower(p_name) = k OR starts_with(lower(p_name), k || ' ')) AS key FROM part)")
def prefix_match_longest(spark, sf_dir):
    return search.longest_prefix(table(spark, sf_dir, "part"), "p_name", ["cold", "cold widget", "small", "sm"]).select("p_partkey", "key", "rest")


@query("suffix_token_unique", "WITH x AS (SELECT doc_id, right(md5(CAST(doc_id AS VARCHAR)), 3) AS token FROM documents), n AS (SELECT token, count(*) AS n, min(doc_id) AS doc_id FROM x GROUP BY token) SELECT token, CASE WHEN n = 1 THEN doc_id END AS doc_id FROM n")
def suffix_token_unique(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.right(F.md5(F.col("doc_id").cast("string")), F.lit(3)).alias("token"))
    return tokens.groupBy("token").agg(F.when(F.count("*") == 1, F.min("doc_id")).alias("doc_id"))


_THINGS = "WITH things AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS thing FROM lineitem), picks AS (SELECT DISTINCT o_custkey AS u, o_orderkey AS item FROM orders), total AS (SELECT count(DISTINCT item) AS items FROM things), rare AS (SELECT thing, count(*) AS n, ln(any_value(items) / count(*)) AS rarity FROM things, total GROUP BY thing)\n"


def _things(spark, sf_dir):
    things = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("thing")).distinct()
    picks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), F.col("o_orderkey").alias("item"))
    return things, picks


@query("rarity_index", _THINGS + "SELECT thing, n, round(rarity, 6) AS rarity FROM rare")
def rarity_index(spark, sf_dir):
    things, _ = _things(spark, sf_dir)
    return recommend.rarity(things, "item", "thing").withColumn("rarity", F.round("rarity", 6))


@query(
    "for_you",
    _THINGS
    + """, prof AS (SELECT u, thing, least(count(*), 3) AS times FROM picks JOIN things USING (item) GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT u, item, sum(times * rarity) AS score, count(*) AS reasons FROM prof JOIN rare USING (thing) JOIN things USING (thing) GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY u ORDER BY round(score, 6) DESC, item) AS r FROM s WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE p.u = s.u AND p.item = s.item)) SELECT u, item, round(score, 6) AS score, reasons, r FROM r WHERE r <= 8""",
)
def for_you(spark, sf_dir):
    things, picks = _things(spark, sf_dir)
    found = recommend.scored(recommend.profile(picks, things, "u", "item", "thing"), things, recommend.rarity(things, "item", "thing"), picks, "u", "item", "thing")
    return recommend.top_each(found.withColumn("score", F.round("score", 6)), "u", "score", "item", 8)


@query("visible_rows", "WITH m AS (SELECT c_custkey AS u, c_nationkey AS crew FROM customer) SELECT event_id, user_id FROM events WHERE user_id = 7 OR user_id IN (SELECT u FROM m WHERE crew IN (SELECT crew FROM m WHERE u = 7))")
def visible_rows(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("crew"))
    return recommend.visible(table(spark, sf_dir, "events").select("event_id", "user_id"), members, 7, "user_id", "crew")


@query("rule_problems", "SELECT 'positive price' AS rule, CAST(o_orderkey AS VARCHAR) AS key, count(*) AS n_rows FROM orders WHERE NOT coalesce(o_totalprice > 1000, false) GROUP BY 2 UNION ALL SELECT 'known status', CAST(o_orderkey AS VARCHAR), count(*) FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false) GROUP BY 2")
def rule_problems(spark, sf_dir):
    return quality.problems(table(spark, sf_dir, "orders"), "o_orderkey", {"positive price": F.col("o_totalprice") > 1000, "known status": F.col("o_orderstatus").isin("F", "O")})


@query("repeated_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return quality.repeated_keys(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("missing_references", "SELECT event_id, user_id AS missing FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def missing_references(spark, sf_dir):
    return quality.missing_references(table(spark, sf_dir, "events"), "event_id", "user_id", table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0"), "c_custkey")


@query("alias_collisions", "SELECT regexp_replace(regexp_replace(regexp_replace(lower(p_type), '^the +', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS key, count(DISTINCT p_brand) AS n, min(p_brand) AS first_id FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def alias_collisions(spark, sf_dir):
    return quality.alias_collisions(table(spark, sf_dir, "part"), text.slug(F.col("p_type")), "p_brand")


@query("share_gate", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n, (SELECT count(*) FROM orders) AS whole, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') <= (SELECT count(*) FROM orders) * 0.3 AS passes")
def share_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return quality.share_gate(o.filter("o_orderstatus = 'P'"), o, Decimal("0.3"))


@query(
    "snapshot_digest",
    "WITH h AS (SELECT sha256(CAST(json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus, 'o_orderpriority', o_orderpriority) AS VARCHAR)) AS h FROM orders), p AS (SELECT count(*) AS n, "
    + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR) AS s{k}" for k in range(4))
    + " FROM h) SELECT n, sha256(concat_ws(':', CAST(n AS VARCHAR), s0, s1, s2, s3)) AS digest FROM p",
)
def snapshot_digest(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("chat_turns", "SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, length(text) - coalesce(lag(length(text)) OVER w, 0) AS grown FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def chat_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), (F.length("text") - F.coalesce(F.lag(F.length("text")).over(w), F.lit(0))).cast("bigint").alias("grown"))


@query("round_robin_sample", "WITH h AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS depth FROM documents) SELECT doc_id, source, depth FROM h WHERE depth <= 5")
def round_robin_sample(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(w).cast("bigint").alias("depth")).filter("depth <= 5")


def part_versions(spark, sf_dir):
    """Two versions of every part: the later one has other brands and no sizes by rule."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("x"), F.col("p_type").alias("y"), F.col("p_size").alias("z"))
    return p, p.withColumns({"x": F.when(F.col("id") % 23 == 3, "X").otherwise(F.col("x")), "z": F.when(F.col("id") % 37 != 5, F.col("z"))})


@query(
    "two_of_three",
    """WITH a AS (SELECT p_partkey AS id, p_brand AS x, p_type AS y, p_size AS z FROM part), b AS (SELECT id, CASE WHEN id % 23 = 3 THEN 'X' ELSE x END AS x, y, CASE WHEN id % 37 <> 5 THEN z END AS z FROM a)
SELECT a.id AS gone, b.id AS new FROM a JOIN b ON a.x = b.x AND a.y = b.y UNION SELECT a.id, b.id FROM a JOIN b ON a.x = b.x AND a.z = b.z UNION SELECT a.id, b.id FROM a JOIN b ON a.y = b.y AND a.z = b.z""",
)
def two_of_three(spark, sf_dir):
    """Every part against every part of a later version."""
    from ..operators.identity import two_of_three as match

    return match(*part_versions(spark, sf_dir), "id", ["x", "y", "z"])
