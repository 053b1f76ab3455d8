"""Queries of names, wording and clock expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, names
from .catalog import query, table

_FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"


@query("folded_text", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(names.fold("text").cast("binary")).alias("folded"))


@query("folded_term_counts", rf"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(string_split(trim(regexp_replace(replace(replace({_FOLD.format('text')}, '&', ' and '), '''', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term NOT IN ('', " + ", ".join(f"'{w}'" for w in names.STOP_WORDS) + ") GROUP BY ALL")
def folded_term_counts(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("lang", names.fold("text").alias("t")).select("lang", F.explode(names.search_terms(F.col("t"))).alias("term"))
    return terms.groupBy("lang", "term").agg(F.count("*").alias("n"))


@query("evidence_found", rf"SELECT d.doc_id, contains(regexp_replace({_FOLD.format('text')}, '[^\p{{L}}\p{{N}}]+', '', 'g'), 'thisworkislicensed') AS found FROM documents d")
def evidence_found(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.has_evidence(names.fold("text"), F.lit("This work, is *licensed*".lower())).alias("found"))


_PEOPLE = [
    ("Dr. Ada B. Vale, PhD", "ada-b-vale", "dr,phd"), ("Prof. Sir Ulm Oster", "ulm-oster", "prof,sir"), ("Dr. Who", "dr-who", ""), ("Rey O'Lan Jr.", "rey-olan", "jr"), ("Mina  Sól", "mina-sól", ""), ("Sr. Jr.", "sr-jr", ""),
]


@query("person_keys", "WITH p(k, key, aside) AS (VALUES " + ", ".join(f"({k}, '{p[1]}', '{p[2]}')" for k, p in enumerate(_PEOPLE)) + f") SELECT c_custkey, key, aside FROM customer JOIN p ON c_custkey % {len(_PEOPLE)} = k")
def person_keys(spark, sf_dir):
    said = F.get(F.array(*[F.lit(p[0]) for p in _PEOPLE]), (F.col("c_custkey") % len(_PEOPLE)).cast("int"))
    parts = table(spark, sf_dir, "customer").select("c_custkey", names.person_parts(said).alias("p"))
    return parts.select("c_custkey", "p.key", F.array_join("p.aside", ",").alias("aside"))


@query("work_slugs", "SELECT p_partkey, (p_partkey + 1) * 1000 || '-leagues-of-' || replace(p_name, ' ', '-') AS slug FROM part")
def work_slugs(spark, sf_dir):
    name = F.concat(F.format_number((F.col("p_partkey") + 1) * 1000, 0), F.lit(" Leagues of: "), F.initcap("p_name"), F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", names.work_slug(name).alias("slug"))


@query("role_splits", "SELECT s_suppkey, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'host' ELSE 'guest' END AS role FROM supplier")
def role_splits(spark, sf_dir):
    said = F.concat("s_name", F.get(F.array(F.lit(""), F.lit(" (host)"), F.lit(" (as Moth) (guest) "), F.lit("(a)(b) (guest)")), (F.col("s_suppkey") % 4).cast("int")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.roles(said).alias("r")).select("s_suppkey", "r.name", "r.role")


_LINES = [
    ("A talk.\nPanelists: Ada Vale, Ulm Oster, Jr., Mina Sol\nBring paper.", "Ada Vale|Ulm Oster Jr|Mina Sol", "A talk.\nBring paper."), ("Additional Panelists: Rey Lan and Ada Vale.", "Rey Lan|Ada Vale", ""), ("panelist:", "", ""), ("No line here", "", "No line here"),
]


@query("panel_lines", "WITH p(k, people, rest) AS (VALUES " + ", ".join(f"({k}, '{p[1]}', '{p[2]}')" for k, p in enumerate(_LINES)) + ") SELECT p_partkey, people, rest FROM part JOIN p ON p_partkey % 4 = k")
def panel_lines(spark, sf_dir):
    line = F.get(F.array(*[F.lit(p[0]) for p in _LINES]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.panel_names(line), "|").alias("people"), names.without_panel(line).alias("rest"))


@query("bare_titles", "SELECT p_partkey, p_name AS title FROM part")
def bare_titles(spark, sf_dir):
    forms = F.array(F.concat(F.lit("CANCELLED: "), "p_name"), F.concat("p_name", F.lit(" [18+] ($5.00)")), F.concat("p_name", F.lit(" 21+ $12")), F.concat(F.lit("  "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", names.bare_title(F.get(forms, (F.col("p_partkey") % 4).cast("int"))).alias("title"))


@query("words_held", r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])licenses?($|[^\p{L}\p{N}])') AS held, regexp_matches(text, '(?is)\bwork\b.{0,60}\blicensed\b') AS cued FROM documents")
def words_held(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.holds_word(F.col("text"), "license").alias("held"), names.cued(F.col("text"), "licensed", "work").alias("cued"))


@query("same_places", "SELECT p_partkey, p_partkey % 3 < 2 AS same FROM part")
def same_places(spark, sf_dir):
    other = F.get(F.array(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), F.concat(F.lit(" "), "p_name", F.lit(".")), F.concat("p_name", F.lit("2"))), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.same_place(F.col("p_name"), other).alias("same"))


@query("canonical_names", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Little' WHEN 'LARGE' THEN 'Big' ELSE p_type END AS name, p_type IN ('SMALL', 'PROMO') AS generic FROM part")
def canonical_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.canonical(F.col("p_type"), {"small": "Little", "large": "Big"}).alias("name"), names.generic(F.concat("p_type", F.lit("s")), ["smalls", "promo"]).alias("generic"))


@query("escaped_texts", r"SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '" + '"' + r"', '&quot;'), '''', '&#39;')) AS html, md5(regexp_replace(regexp_replace(text, '([\\`*_\[\]|<>])', '\\\1', 'g'), '\r?\n', ' ', 'g')) AS markdown FROM documents")
def escaped_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(names.html_escaped(F.col("text"))).alias("html"), F.md5(names.markdown_escaped(F.col("text"))).alias("markdown"))


@query("first_places", "SELECT doc_id, CASE WHEN regexp_matches(lang, 'licen[cs]e') THEN 'title' WHEN regexp_matches(substr(text, 1, 600), 'licen[cs]e') THEN 'head' WHEN regexp_matches(text, 'licen[cs]e') THEN 'past' END AS found FROM documents")
def first_places(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.first_place(F.col("lang"), F.col("text"), "licen[cs]e").alias("found"))


@query("ordinal_words", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 10 END AS number FROM part")
def ordinal_words(spark, sf_dir):
    word = F.get(F.array(F.lit("Third"), F.lit("12th"), F.lit("tenth"), F.lit("none")), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.ordinal(word).alias("number"))


_ZONE = "America/New_York"


@query("order_instants", "SELECT o_orderkey, CAST(timezone('UTC', timezone('America/New_York', o_orderdate + INTERVAL 20 HOUR)) AS TIMESTAMP) AS at_utc, o_orderdate + INTERVAL 20 HOUR + INTERVAL 4 HOUR = timezone('UTC', timezone('America/New_York', o_orderdate + INTERVAL 20 HOUR)) AS summer FROM orders")
def order_instants(spark, sf_dir):
    local = F.col("o_orderdate") + F.expr("INTERVAL 20 HOUR")
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.instant(local, _ZONE).cast("timestamp_ntz").alias("at_utc"), clock.summer_time(local, _ZONE, -4).alias("summer"))


@query("in_season", "SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AS inside FROM events")
def in_season(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", clock.in_season(at, _ZONE, F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")).alias("inside"))


@query("con_day_list", "WITH d AS (SELECT unnest(range(CAST(min(ts) - INTERVAL 5 HOUR AS DATE), CAST(max(ts) - INTERVAL 5 HOUR AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM events) SELECT CAST(day AS DATE) AS day, dayname(day) AS weekday FROM d")
def con_day_list(spark, sf_dir):
    span = table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.select(F.explode(clock.con_days(F.col("a"), F.col("b"))).alias("d")).select("d.day", "d.weekday")


@query("relative_days", "WITH e AS (SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS today, event_id % 4 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN today WHEN 1 THEN today + 1 WHEN 2 THEN today + CAST((5 - isodow(today) + 7) % 7 AS INTEGER) END AS day FROM e")
def relative_days(spark, sf_dir):
    word = F.get(F.array(F.lit("Tonight"), F.lit("tomorrow"), F.lit("Friday"), F.lit("soon")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", clock.relative_day(word, F.col("ts")).alias("day"))


@query("spoken_clock", "WITH t AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 96 * 15 AS INTEGER)) AS t, o_orderkey % 200 AS m FROM orders) SELECT o_orderkey, CASE WHEN hour(t) = 12 AND minute(t) = 0 THEN 'noon' WHEN hour(t) = 0 AND minute(t) = 0 THEN 'midnight' WHEN minute(t) = 0 THEN strftime(t, '%-I %p') ELSE strftime(t, '%-I:%M %p') END AS said, CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN m // 60 || ' h' ELSE m // 60 || ' h ' || m % 60 || ' min' END AS took FROM t")
def spoken_clock(spark, sf_dir):
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 96 * 15).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.spoken(at).alias("said"), clock.told_duration(F.col("o_orderkey") % 200).alias("took"))


@query("later_stamps", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2024-01-01T10:00:00+02:00' WHEN event_id % 3 = 1 THEN '2024-01-01T09:30:00Z' ELSE '2024-01-01T09:00:00Z' END AS later FROM events")
def later_stamps(spark, sf_dir):
    k = (F.col("event_id") % 3).cast("int")
    a = F.get(F.array(F.lit("2024-01-01T10:00:00+02:00"), F.lit("2024-01-01T10:00:00+02:00"), F.lit("not a stamp")), k)
    b = F.get(F.array(F.lit("2024-01-01T08:00:00Z"), F.lit("2024-01-01T09:30:00Z"), F.lit("2024-01-01T09:00:00Z")), k)
    return table(spark, sf_dir, "events").select("event_id", clock.later_stamp(a, b).alias("later"))


@query("share_days", "SELECT user_id, coalesce(min(d) FILTER (WHERE d >= DATE '2024-01-20'), min(d)) AS day FROM (SELECT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY user_id")
def share_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(clock.share_day(F.to_date("ts"), F.lit("2024-01-20").cast("date")).alias("day"))
