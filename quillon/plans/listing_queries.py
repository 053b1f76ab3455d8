"""Queries of a listing's rows: parts, events and orders as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import con_day
from ..operators import interval, labelling, listing, ordered
from .catalog import query, table


@query("chosen_rows", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_size BETWEEN 1 AND 25 AND list_has_any(string_split(p_name, ' '), ['red', 'widget']) AND p_brand <> 'Brand#3' AND p_retailprice > 900")
def chosen_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    choices = {
        "type": (F.col("p_type"), ["SMALL", "ECONOMY"]), "half": (F.col("p_size") <= 25, True), "words[]": (F.split("p_name", " "), ["red", "widget"]), "brand": (F.col("p_brand") == "Brand#3", False),
        "dear": (F.col("p_retailprice") > 900, True), "place": (F.col("p_brand"), "All"), "kind": (F.col("p_type"), None), "size": (F.col("p_size") >= 1, True),
    }
    return p.filter(listing.wanted(choices)).select("p_partkey")


@query("ways_in", "SELECT CASE WHEN so THEN 'full' WHEN cost > 0 AND su THEN 'pay and sign up' WHEN cost > 0 THEN 'pay' WHEN su THEN 'sign up' WHEN cost IS NOT NULL OR su IS NOT NULL OR so IS NOT NULL THEN 'nothing' END AS way, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 > 0 THEN p_size % 3 END AS cost, CASE WHEN p_size % 5 > 1 THEN p_size % 2 = 0 END AS su, CASE WHEN p_size % 7 > 4 THEN p_size % 2 = 1 END AS so FROM part) GROUP BY 1")
def ways_in(spark, sf_dir):
    s = F.col("p_size")
    way = listing.getting_in(F.when(s % 4 > 0, s % 3), F.when(s % 5 > 1, s % 2 == 0), F.when(s % 7 > 4, s % 2 == 1))
    return table(spark, sf_dir, "part").groupBy(way.alias("way")).agg(F.count("*").alias("n"))


@query("cancelled_rows", "SELECT p_partkey, p_partkey % 4 < 3 AS cancelled FROM part")
def cancelled_rows(spark, sf_dir):
    k = (F.col("p_partkey") % 4).cast("int")
    title = F.get(F.array(F.concat(F.lit("CANCELLED: "), "p_name"), F.concat("p_name", F.lit(" (canceled)")), F.col("p_name"), F.concat(F.lit("The cancelled "), "p_name")), k)
    text = F.get(F.array(F.lit("x"), F.lit("x"), F.lit("This panel has been cancelled."), F.lit("It was not cancelled")), k)
    return table(spark, sf_dir, "part").select("p_partkey", listing.is_cancelled(title, text).alias("cancelled"))


@query("quiet_rows", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('red', 'blue', 'bolt', 'gear'))) = 0 AS noise FROM part")
def quiet_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", listing.noise(F.split("p_name", " "), ["red", "blue", "bolt", "gear"]).alias("noise"))


@query("soon_rows", "SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-12 10:00:00' AND ts <= TIMESTAMP '2024-01-12 13:00:00'")
def soon_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(listing.soon(F.col("ts"), F.col("ts") + F.expr("INTERVAL 30 MINUTE"), F.lit("2024-01-12 10:00:00").cast("timestamp_ntz"), 180)).select("event_id")


@query("formed_keys", "SELECT event_id, event_id % 5 IN (0, 2) AS good FROM events")
def formed_keys(spark, sf_dir):
    k = (F.col("event_id") % 5).cast("int")
    key = F.get(F.array(F.lit("medium:film-1"), F.lit("Medium:film"), F.lit("Ada-Vale.2"), F.lit("-x"), F.lit(None).cast("string")), k)
    return table(spark, sf_dir, "events").select("event_id", listing.well_formed(key, F.when(k < 2, "axis").otherwise("person")).alias("good"))


@query("listing_rows", "SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS con_day, 'Room ' || user_id AS clean_room, event_type || ', ' || user_id AS people_text, CASE event_type WHEN 'click' THEN 'Room ' || user_id ELSE event_type || ' · Room ' || user_id END AS place FROM events")
def listing_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"room": F.concat(F.lit("Room (upper level) "), "user_id"), "people": F.array("event_type", F.col("user_id").cast("string"))})
    rows = listing.derived(e, "ts", "room", "people")
    return rows.select("event_id", "con_day", "clean_room", "people_text", listing.room_words(F.col("event_type"), F.col("clean_room"), ["click"]).alias("place"))


@query("tagger_answers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'answer ' || lang END AS answer FROM documents")
def tagger_answers(spark, sf_dir):
    """Inputs of a labeller with the cached answer of their key."""
    d = table(spark, sf_dir, "documents")
    asked = d.select("doc_id", "lang", listing.tagger_input(F.col("doc_id").cast("string"), F.col("lang"), F.array("source"), F.col("text")).alias("i")).select("doc_id", "lang", "i.*").withColumn("key", labelling.input_key("title", "kind", "text"))
    cache = asked.filter("doc_id % 3 = 0").select("key", F.concat(F.lit("answer "), "lang").alias("answer")).distinct()
    return asked.join(cache, "key", "left").select("doc_id", "answer")


@query("closed_values", "SELECT p_type AS value, count(*) AS n, p_type IN ('SMALL', 'LARGE', 'PROMO') AS ok FROM part GROUP BY p_type")
def closed_values(spark, sf_dir):
    return listing.closed_values(table(spark, sf_dir, "part"), "p_type", ["SMALL", "LARGE", "PROMO"])


@query("repaired_texts", "SELECT doc_id, md5(text) AS text FROM documents")
def repaired_texts(spark, sf_dir):
    """All texts, of every second one the UTF-8 read as Windows-1252, where that has a sign for every byte."""
    misread = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), listing.CONTROLS, listing.WINDOWS)
    broken = F.when((F.col("doc_id") % 2 == 0) & ~misread.rlike("[\u0080-\u009f]"), misread).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(listing.repaired(broken)).alias("text"))


@query("log_faults", "SELECT 'unknown id' AS fault, count(*) AS n FROM lineitem WHERE l_orderkey % 7 = 3 UNION ALL SELECT 'stamp after run', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate - INTERVAL 30 DAY HAVING count(*) > 0")
def log_faults(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    log = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").withColumn("run", F.col("l_shipdate") - F.expr("INTERVAL 30 DAY"))
    return listing.log_faults(log, o.filter("l_orderkey % 7 <> 3"), "l_linenumber", "l_orderkey", "o_orderdate", "run")


@query("same_builds", "SELECT true AS same, 'shuffled' AS build FROM region WHERE r_regionkey = 0 UNION ALL SELECT false, 'edited' FROM region WHERE r_regionkey = 0")
def same_builds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    columns = ["p_partkey", "p_name", "p_size"]
    edited = p.withColumn("p_size", F.when(F.col("p_partkey") == 5, -1).otherwise(F.col("p_size")))
    return listing.same_build(p, p.orderBy(F.desc("p_name")), columns).withColumn("build", F.lit("shuffled")).unionByName(listing.same_build(p, edited, columns).withColumn("build", F.lit("edited")))


@query("answers_read", "SELECT event_id, event_type || '|' || props AS strings, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def answers_read(spark, sf_dir):
    """A model's answer around a JSON array: the array, its strings, and a number of the event's own JSON."""
    said = F.concat(F.lit("Sure: "), F.to_json(F.array(F.struct(F.col("event_type").alias("name"), F.struct(F.array("props").alias("of")).alias("deep")))), F.lit(" - done."))
    e = table(spark, sf_dir, "events").select("event_id", listing.json_array_in(said).alias("a"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("event_id", F.replace(F.array_join(listing.strings_in(F.col("a")), "|"), F.lit("\\"), F.lit("")).alias("strings"), "k")


@query("nearest_rects", "WITH r AS (SELECT p_type AS plate, p_partkey AS rect, (p_size * 7) % 100 AS x0, (p_size * 13) % 100 AS y0 FROM part WHERE p_size % 4 = 0), q AS (SELECT p_type AS plate, p_partkey AS point, p_partkey % 100 AS x, (p_partkey * 3) % 100 AS y FROM part), d AS (SELECT point, rect, round(sqrt(power(greatest(x0 - x, 0, x - x0 - 5), 2) + power(greatest(y0 - y, 0, y - y0 - 5), 2)), 9) AS distance FROM q JOIN r USING (plate)) SELECT point, rect, distance FROM d WHERE distance <= 20 QUALIFY row_number() OVER (PARTITION BY point ORDER BY distance, rect DESC) = 1")
def nearest_rects(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_type", "plate")
    x0, y0 = (F.col("p_size") * 7 % 100).cast("double"), (F.col("p_size") * 13 % 100).cast("double")
    rects = p.filter("p_size % 4 = 0").select("plate", F.col("p_partkey").alias("rect"), x0.alias("x0"), y0.alias("y0"), (x0 + 5).alias("x1"), (y0 + 5).alias("y1"))
    points = p.select("plate", F.col("p_partkey").alias("point"), (F.col("p_partkey") % 100).cast("double").alias("x"), (F.col("p_partkey") * 3 % 100).cast("double").alias("y"))
    return listing.nearest_rect(points, rects, "plate", "point", "x", "y", 20.0)


@query("fitted_boxes", "SELECT p_brand, round(least(800.0 / (max(p_size) - min(p_size) + 1), 600.0 / (max(p_retailprice) - min(p_retailprice) + 1)), 6) AS scale FROM part GROUP BY p_brand")
def fitted_boxes(spark, sf_dir):
    span = lambda c: F.max(c) - F.min(c) + 1
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(listing.fitted(span("p_size"), span("p_retailprice"), 800.0, 600.0), 6).alias("scale"))


@query("walk_estimates", "WITH e AS (SELECT event_id, user_id, user_id % 5 AS hotel, event_id % 5 AS room_hotel, CAST(ts - INTERVAL 5 HOUR AS DATE) AS d, ts FROM events), p AS (SELECT event_id, room_hotel AS b, lag(room_hotel) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS a FROM e) SELECT event_id, a, b, 5 + least(a, b) + greatest(a, b) AS minutes FROM p WHERE a <> b")
def walk_estimates(spark, sf_dir):
    """Minutes on foot from the pick before, in another building on the same con day."""
    e = table(spark, sf_dir, "events").withColumns({"b": F.col("event_id") % 5, "d": con_day(F.col("ts"))})
    pairs = interval.with_neighbours(e, ["user_id", "d"], "ts", "event_id", ["b"]).filter("prev_b <> b").select("event_id", F.col("prev_b").alias("a"), "b")
    n = spark.range(5).select(F.col("id").alias("a"))
    walks = n.join(n.select(F.col("a").alias("b")), F.col("a") < F.col("b")).withColumn("minutes", (5 + F.col("a") + F.col("b")).cast("bigint"))  # 5 buildings
    return interval.symmetric_lookup(pairs, walks, "a", "b", "minutes", 99)


@query("hotel_day_counts", "SELECT user_id % 5 AS hotel, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS people, count(*) FILTER (WHERE user_id % 5 > 3) AS off_map FROM events GROUP BY ALL")
def hotel_day_counts(spark, sf_dir):
    hotel = F.col("user_id") % 5
    return table(spark, sf_dir, "events").groupBy(hotel.alias("hotel"), con_day(F.col("ts")).alias("day")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("people"), F.count_if(hotel > 3).alias("off_map"))


@query("shared_day", "WITH t AS (SELECT right(md5(CAST(event_id AS VARCHAR)), 5) AS token, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT right(md5(CAST(event_id AS VARCHAR)), 5) AS token FROM events WHERE event_id % 50 = 3) SELECT count(CASE WHEN n = 1 THEN 1 END) AS found, count(*) - count(CASE WHEN n = 1 THEN 1 END) AS skipped FROM w LEFT JOIN t USING (token)")
def shared_day(spark, sf_dir):
    """A shared day's tokens: how many name one event, and how many are skipped."""
    token = F.right(F.md5(F.col("event_id").cast("string")), F.lit(5))
    e = table(spark, sf_dir, "events").select("event_id", token.alias("token"))
    known = e.groupBy("token").agg(F.count("*").alias("n"))
    return e.filter("event_id % 50 = 3").select("token").join(known, "token", "left").agg(F.count_if(F.col("n") == 1).alias("found"), F.count_if(F.coalesce(F.col("n"), F.lit(0)) != 1).alias("skipped"))


@query("spelling_variants", "SELECT lower(p_type) AS key, count(DISTINCT spelling) AS spellings, min(spelling) AS first FROM (SELECT p_type, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS spelling FROM part) GROUP BY 1 HAVING count(DISTINCT spelling) > 1")
def spelling_variants(spark, sf_dir):
    spelling = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("key")).agg(F.count_distinct(spelling).alias("spellings"), F.min(spelling).alias("first")).filter("spellings > 1")


@query("unlisted_people", "SELECT count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R' OR l_linestatus = 'O') AS adding FROM lineitem")
def unlisted_people(spark, sf_dir):
    """Lines whose people the listed ones lack."""
    extra = F.array_except(F.array("l_returnflag", "l_linestatus"), F.array(F.lit("A"), F.lit("N"), F.lit("F")))
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("lines"), F.count_if(F.size(extra) > 0).alias("adding"))


@query("composite_sets", "WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS flags FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE flags WHEN 'AN' THEN 'one' WHEN 'ANR' THEN 'all' END AS composite FROM s")
def composite_sets(spark, sf_dir):
    """Rooms selected together, named where the set is exactly a composite."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"))
    composites = spark.createDataFrame([("AN", "one"), ("ANR", "all")], "flags string, composite string")
    return sets.join(F.broadcast(composites), "flags", "left").select("l_orderkey", "composite")  # two rows


@query("mapped_labels", "SELECT p_partkey, array_to_string(list_slice(list_filter([CASE p_type WHEN 'SMALL' THEN 'size:s' WHEN 'LARGE' THEN 'size:l' WHEN 'PROMO' THEN 'price:low' END, CASE WHEN p_name LIKE '%widget%' THEN 'thing:widget' END], lambda x: x IS NOT NULL), 1, 1), ',') AS axes FROM part")
def mapped_labels(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for x in ("SMALL", "size:s", "LARGE", "size:l", "PROMO", "price:low", "widget", "thing:widget")])
    labels = F.transform(F.concat(F.array("p_type"), F.split("p_name", " ")), lambda t: F.try_element_at(known, t))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(F.filter(labels, lambda x: x.isNotNull()), 1, 1), ",").alias("axes"))


@query("sorted_titles", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, lower(p_name), p_partkey) AS r FROM part")
def sorted_titles(spark, sf_dir):
    """Places in a listing by start and then by title, whatever its case."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return ordered.numbered(p, [F.col("p_size"), F.lower("p_name"), F.col("p_partkey")]).select("p_partkey", "r")


@query("census_report", "SELECT 'documents' AS section, 'all' AS name, count(*) AS n FROM documents UNION ALL SELECT 'language', coalesce(lang, 'none'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'length', CASE WHEN n_chars <= 500 THEN 'short' WHEN n_chars <= 5000 THEN 'middle' ELSE 'long' END, count(*) FROM documents WHERE n_chars IS NOT NULL GROUP BY 2 UNION ALL SELECT 'labelled', CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'other' END, count(*) FROM labels GROUP BY 2 UNION ALL SELECT 'unlabelled', 'all', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def census_report(spark, sf_dir):
    """Counts of a corpus by section: one pass for what a row says of itself, joins for what other tables say."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    length = F.when(F.col("n_chars") <= 500, "short").when(F.col("n_chars") <= 5000, "middle").when(F.col("n_chars").isNotNull(), "long")
    line = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    own = d.select(F.explode(F.array(line("documents", F.lit("all")), line("language", F.coalesce("lang", F.lit("none"))), line("length", length))).alias("x"))
    said = l.select(line("labelled", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("other")).alias("x"))
    rest = d.join(l, "doc_id", "left_anti").select(line("unlabelled", F.lit("all")).alias("x"))
    return own.unionByName(said).unionByName(rest).filter("x.name IS NOT NULL").groupBy("x.section", "x.name").agg(F.count("*").alias("n"))
