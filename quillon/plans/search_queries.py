"""Queries of search over several fields, on parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import ranking, search
from .catalog import query, table

_W = "regexp_extract_all(lower({0}), '([a-z0-9à-ÿ]+)')"
_BOOSTS = {"title": 5.0, "kind": 2.0, "maker": 1.0}
_ASKED = ["small", "widget", "economy", "brand"]
_FIELDS = f"""WITH f AS (SELECT p_partkey AS doc, 'title' AS field, 5.0::DOUBLE AS boost, {_W.format('p_name')} AS w FROM part UNION ALL SELECT p_partkey, 'kind', 2.0, {_W.format('p_type')} FROM part UNION ALL SELECT p_partkey, 'maker', 1.0, {_W.format('p_brand')} FROM part),
x AS (SELECT doc, field, boost, len(w) AS len, unnest(w) AS term FROM f), tf AS (SELECT doc, field, boost, len, term, count(*) AS tf FROM x GROUP BY ALL),
means AS (SELECT field, avg(len(w)) AS mean FROM f GROUP BY field), dfs AS (SELECT term, count(DISTINCT doc) AS df FROM tf GROUP BY term),
b AS (SELECT doc, term, sum(boost * ln(1 + ((SELECT count(*) FROM part) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN means USING (field) JOIN dfs USING (term) WHERE term IN ('small', 'widget', 'economy', 'brand') GROUP BY ALL)
"""


def part_index(spark, sf_dir):
    return ranking.field_postings(table(spark, sf_dir, "part"), "p_partkey", {"title": F.col("p_name"), "kind": F.col("p_type"), "maker": F.col("p_brand")})


@query("field_index", _FIELDS + "SELECT term, field, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM tf GROUP BY ALL")
def field_index(spark, sf_dir):
    return part_index(spark, sf_dir).groupBy("term", "field").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


@query("boosted_search", _FIELDS + "SELECT doc, count(*) AS n_terms, round(sum(score), 6) AS score FROM b GROUP BY doc")
def boosted_search(spark, sf_dir):
    scored = ranking.boosted(part_index(spark, sf_dir), _ASKED, _BOOSTS)
    return scored.groupBy("doc").agg(F.count("*").alias("n_terms"), F.round(F.sum("score"), 6).alias("score"))


@query(
    "reranked_search",
    f"""WITH d AS (SELECT p_partkey AS doc, {_W.format('p_name')} AS w, p_size AS score FROM part), q(query) AS (VALUES ('small'), ('wid'), ('red')),
m AS (SELECT DISTINCT doc, score, query, term FROM (SELECT doc, score, unnest(w) AS term FROM d), q WHERE term = query OR starts_with(term, query)),
e AS (SELECT doc, score, query, max(CASE WHEN query = term THEN 1.0::DOUBLE ELSE length(query) / length(term) END) AS q FROM m GROUP BY ALL)
SELECT doc, any_value(score) AS score, round(count(*) / 3, 6) AS coverage, round(sum(q) / 3, 6) AS quality, round(any_value(score) * (0.5 + count(*) / 3) * (1 + 0.5 * sum(q) / 3), 6) AS rank_score FROM e GROUP BY doc""",
)
def reranked_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_partkey").alias("doc"), F.explode(F.array_distinct(words(F.col("p_name")))).alias("term"))
    asked = spark.createDataFrame([("small",), ("wid",), ("red",)], "query string")
    matches = terms.join(F.broadcast(asked), F.col("term").startswith(F.col("query")))  # the query's words
    found = ranking.reranked(p.select(F.col("p_partkey").alias("doc"), F.col("p_size").alias("score")), matches, 3)
    return found.select("doc", "score", *[F.round(c, 6).alias(c) for c in ("coverage", "quality", "rank_score")])


_GROUPS = [("a", "small"), ("a", "tiny one"), ("b", "red widget"), ("b", "ruby gadget"), ("c", "ring")]


@query("synonym_expand", "WITH g(grp, phrase) AS (VALUES ('a', 'small'), ('a', 'tiny one'), ('b', 'red widget'), ('b', 'ruby gadget'), ('c', 'ring')) SELECT DISTINCT p_partkey AS doc, o.phrase AS term FROM part JOIN g ON contains(' ' || lower(p_name) || ' ', ' ' || g.phrase || ' ') JOIN g o ON o.grp = g.grp")
def synonym_expand(spark, sf_dir):
    groups = spark.createDataFrame(_GROUPS, "grp string, phrase string")
    return ranking.synonym_terms(table(spark, sf_dir, "part"), "p_partkey", words(F.col("p_name")), groups, 2)


@query("exact_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_W.format('text')}, ' ') || ' ', ' public license ')")
def exact_phrase(spark, sf_dir):
    return ranking.with_phrase(table(spark, sf_dir, "documents"), words(F.col("text")), "Public  license").select("doc_id")


@query("result_sections", "SELECT event_id, section, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'past' THEN -epoch_us(ts) ELSE epoch_us(ts) END, event_id) AS r FROM (SELECT event_id, ts, CASE WHEN ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-12 10:00:00' THEN 'past' WHEN value < 10 THEN 'loose' ELSE 'upcoming' END AS section FROM events WHERE event_type = 'click')")
def result_sections(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").withColumn("until", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return ranking.sections(e, "event_id", "ts", "until", F.col("value") < 10, F.lit("2024-01-12 10:00:00").cast("timestamp_ntz"))


@query("place_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#7')")
def place_filter(spark, sf_dir):
    composites = spark.createDataFrame([("Brand#7", "Brand#2"), ("Brand#7", "Brand#3"), ("Brand#8", "Brand#3")], "composite string, room string")
    return ranking.at_place(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#1", "Brand#2"], composites)


@query("hidden_matches", "SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' AND n_chars <= 1000 GROUP BY source")
def hidden_matches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang = 'fr'")
    return ranking.hidden(d, d.filter("n_chars > 1000"), "doc_id", "source")


@query("match_kinds", f"WITH v AS (SELECT DISTINCT unnest({_W.format('p_name')}) AS term FROM part), q(query) AS (VALUES ('widget'), ('smal'), ('lerge')), m AS (SELECT query, CASE WHEN term = query THEN 'exact' WHEN starts_with(term, query) THEN 'prefix' WHEN length(query) > 4 AND levenshtein(term, query) <= 1 THEN 'close' END AS how FROM v, q) SELECT query, bool_or(how = 'exact') AS exact, bool_or(how = 'prefix') AS prefix FROM m WHERE how IS NOT NULL GROUP BY query")
def match_kinds(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "part").select(F.explode(words(F.col("p_name"))).alias("term")).distinct()
    return ranking.how_matched(search.fuzzy_terms(vocabulary, ["widget", "smal", "lerge"]))


@query("prefix_names", "WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT p_name || ' ' || p_type FROM part) SELECT a.name AS short, b.name AS long FROM n a JOIN n b ON starts_with(b.name, a.name || ' ')")
def prefix_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat_ws(" ", "p_name", "p_type"))).alias("name"))
    return ranking.prefix_pairs(names, "name")
