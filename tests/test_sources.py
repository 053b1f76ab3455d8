"""Sources, sinks, streams, layouts and drawings on small tables, odd rows among them."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quillon.operators import geometry, labelling, layout, places
from quillon.plans import source_queries
from quillon.sources import calendar, lines, pages, snapshots
from quillon.streaming import events as streams


def test_page_record_reads_each_text_once(spark):
    html = (
        "<html><head><title> A  page </title><script>var x='<p>no</p>'</script></head><body><h1>Head</h1><h1>Other</h1>"
        "<table><tr><td>Location</td><td>Hall &amp; Room</td></tr><tr><td>lone</td></tr></table><p>one<p>two<br>three</p><a href='/x'>x</a></body>"
    )
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: r for r in pages.records(df, "page_id", "html").collect()}
    assert (got[1].title, got[1].heading, got[1].description) == ("A page", "Head", "one\ntwo\nthree")
    assert got[1].fields == {"location": "Hall & Room"} and got[1].links == ["/x"]
    assert got[2].description == "" and got[3].links == []


def test_detail_page_has_sections_outermost_paragraphs_and_repairs(spark):
    def section(heading, inside):
        return f'<div class="section">{heading and f"<h2 class=section_heading>{heading}</h2>"}{inside}</div>'

    html = (
        '<h1>Other</h1><h1 class="x header_title">CafÃ©  night</h1><table><tr><td>Location</td><td>outside</td></tr></table><div class="template_content"><script>x="<p>no</p>"</script>'
        "<table><tr><td>LOCATION </td><td>Hall&nbsp;&amp; Room</td></tr><tr><td>Location</td><td>Last <i>room</i></td><td>x</td></tr><tr><td>Duration</td></tr></table>"
        + section("", "<p> </p>") + section("", "<p>one<br><p>two â€“ <b>three</b></p></p><p>four</span>") + section("", "<p>later</p>")
        + section("Speakers", '<ul><li><i class="line one">Host</i><i class="line two">Ann Ã©</i><li><i class="line two">Bo</i></li></ul><li><i class="line one">Nobody</i>')
        + section(" SPEAKERS", '<li><i class="line two one">Cy</i></li>') + section("Tracks", "<a>gone</a>") + section("Tracks", "<a>Film</a><a> </a><a>TV<br>2</a>") + "</div>" + section("", "<p>behind</p>")
    )
    df = spark.createDataFrame([("a", html), ("b", None), ("c", ""), ("d", "<p>" * 3000 + "x" + "<li>" * 3000), ("e", section("", "<p>no content part"))], "page string, html string")
    got = {r.page: r for r in pages.details(df, "page", "html").collect()}
    a = got["a"]
    assert (a.title, a.location, a.date_text, a.duration_text) == ("Café night", "Last room", "", "")
    assert a.description == "one\ntwo – three\nfour"  # of nested paragraphs the outer one, and the first section that says anything
    assert [tuple(s) for s in a.speakers] == [("Ann é", "Host"), ("Bo", ""), ("Cy", "Cy")] and a.tracks == ["Film", "TV2"]
    assert a.repaired == 3  # title, description, one name
    assert all((got[k].title, got[k].description, got[k].speakers, got[k].tracks, got[k].repaired) == ("", "", [], [], 0) for k in "bcd")
    assert got["e"].description == "no content part"
    assert pages.details(df.limit(0), "page", "html").count() == 0


def test_page_details_reads_open_references_as_its_sql(spark, tmp_path):
    """Headings cut within a reference: `&amp` without its end stands as it is, in the SQL too."""
    import duckdb

    from quillon.plans import catalog, registered  # noqa: F401

    html = '<title>x</title><nav><ul><li><a href="/a&ampb">A&amp;B &lt</a></li></ul></nav><article><h1>{}</h1><p>one &amp; two &copy &#39;</p><p>é &quot;x&quot</p></article>'
    rows = [(k, f"https://x.example/{k}?a=1&copy=2&amp=3", html.format(h)) for k, h in enumerate(["The&amp;&amp", "the&am", "&", "é &amp;amp;", "a &lt; b&quo", "&amp;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.SQL["page_details"])
    got = catalog.QUERIES["page_details"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert {r.page_id: r.title for r in got.collect()}[0] == "The&&amp"


def test_page_records_give_one_row_a_page(spark, sf):
    got = source_queries.page_records(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert got.filter("title <> '' AND description <> ''").count() > 0


def test_json_lines_round_trip_and_problems(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "id long, says string")
    lines.write_json_lines(df, ["id", "says"], ["id"], f"{tmp_path}/ok")
    back = lines.read_lines(spark, f"{tmp_path}/ok", df.schema)
    assert sorted(back.select("id", "says").collect()) == sorted(df.collect(), key=lambda r: r.id)
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "says": "a"}\n\n{"id": 1}\nnot json\n')
    found = lines.problems(lines.read_lines(spark, f"{tmp_path}/bad.jsonl", df.schema), ["id"]).collect()
    assert sorted((r.problem, r.says, r.n) for r in found) == [("repeated key", '{"id":1}', 2), ("unreadable", "not json", 1)]
    last = lines.last_wins(spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 1, "c")], "id long, at long, v string"), ["id"], "at")
    assert sorted(r.v for r in last.collect()) == ["b", "c"]


def test_snapshots_are_read_once_their_manifest_is(spark, tmp_path):
    folder, df = str(tmp_path), spark.range(5)
    assert snapshots.latest_version(spark, folder) is None
    assert snapshots.commit(spark, folder, {"a": df, "b": df.limit(0)}) == 1
    spark.range(9).write.parquet(f"{folder}/a/version=2")  # a run that stopped before its manifest
    assert snapshots.read(spark, folder, "a").count() == 5 and snapshots.read(spark, folder, "b").count() == 0
    assert snapshots.commit(spark, folder, {"a": spark.range(7)}) == 2
    assert snapshots.read(spark, folder, "a").count() == 7 and snapshots.read(spark, folder, "a", 1).count() == 5
    with pytest.raises(ValueError):
        snapshots.read(spark, folder, "b")


def test_calendar_leaves_out_nulls(spark):
    df = spark.sql("SELECT 1 AS id, 'a,b' AS t, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS s, CAST(NULL AS TIMESTAMP_NTZ) AS e, CAST(NULL AS STRING) AS p")
    said = calendar.entries(df, "id", "t", "s", "e", "p", "UTC").first().value
    assert said.split("\r\n") == ["BEGIN:VEVENT", "UID:1", "DTSTART;TZID=UTC:20240101T100000", "SUMMARY:a\\,b", "END:VEVENT"]


@pytest.mark.parametrize(
    ("place", "rule", "rooms"),
    [
        ("31-33", "numbers", ["31", "32", "33"]), ("098-100", "numbers", ["098", "099", "100"]), ("K7-K9", "numbers", ["K7", "K8", "K9"]), ("31-90", "plain", ["31-90"]), ("K1-L2", "plain", ["K1-L2"]), ("8-11", "plain", ["8-11"]),
        ("Quay 8-11", "named numbers", ["Quay 8", "Quay 9", "Quay 10", "Quay 11"]), ("Quay 9-8", "plain", ["Quay 9-8"]),
        ("Loft P - R", "letters", ["Loft P", "Loft Q", "Loft R"]), ("Loft K-L-M", "letters", ["Loft K", "Loft L", "Loft M"]), ("Loft R-P", "plain", ["Loft R-P"]), ("Loft L-K-M", "plain", ["Loft L-K-M"]),
        ("Dock II-IV", "roman", ["Dock II", "Dock III", "Dock IV"]), ("Loft MN", "joined letters", ["Loft M", "Loft N"]), ("Loft NM", "plain", ["Loft NM"]), ("52KL", "numbered letters", ["52K", "52L"]),
        ("Loft M/4", "choices", ["Loft M", "Loft 4"]), ("Big Loft East-West", "words", ["Big Loft East", "Big Loft West"]), ("Loft M/4-5", "plain", ["Loft M/4-5"]),
        ("99999999999-99999999999", "plain", ["99999999999-99999999999"]), ("", "plain", [""]), (None, None, None),
    ],
)
def test_place_rules(spark, place, rule, rooms):
    got = spark.createDataFrame([(place,)], "s string").select(places.read_place(F.col("s")).alias("r")).first().r
    assert (got and got.rule, got and got.rooms) == (rule, rooms)


def test_columns_never_hold_two_at_once(spark, sf):
    got = source_queries.timeline_columns(spark, sf).collect()
    at = {r.event_id: (r.s, r.e) for r in source_queries.spans(spark, sf).collect()}
    assert len(got) == len(at)
    taken = {}
    for r in got:
        taken.setdefault((r.user_id, r.col), []).append(at[r.event_id])
    for held in taken.values():
        held.sort()
        assert all(a[1] <= b[0] for a, b in zip(held, held[1:]))
    assert layout.packed_columns(spark.sql("SELECT 1 u, 1 i, current_timestamp() s, current_timestamp() e LIMIT 0"), "u", "i", "s", "e").count() == 0


def test_hull_holds_every_point(spark):
    points = [(k % 2, float(k * 37 % 101), float(k * 53 % 97)) for k in range(400)] + [(2, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0)]
    got = {}
    for r in geometry.convex_hull(spark.createDataFrame(points, "k int, x double, y double"), "k", "x", "y").collect():
        got.setdefault(r.k, []).append((r.position, r.x, r.y))
    assert set(got) == {0, 1, 2} and len(got[2]) == 1
    for k in (0, 1):
        hull = [p[1:] for p in sorted(got[k])]
        for a, b in zip(hull, hull[1:] + hull[:1]):
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for g, x, y in points if g == k)


def test_labeller_is_asked_only_for_misses(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("boom",)], "t string").coalesce(1)
    cache = rows.filter("t = 'b'").select(labelling.input_key("t").alias("key"))
    wanted = labelling.misses(rows, cache, ["t"])
    assert sorted((r.t or "", r.n) for r in wanted.collect()) == [("", 1), ("a", 2), ("boom", 1)]

    def says(batch):
        if any(r["t"] == "boom" for r in batch):
            raise RuntimeError("no answer")
        return [str(r["t"]).upper() for r in batch]

    got = labelling.ask(wanted.filter("t = 'a'"), ["t"], says).collect()
    assert [(r.answer, r.failed) for r in got] == [("A", False)]
    assert [(r.answer, r.failed) for r in labelling.ask(wanted.filter("t = 'boom'"), ["t"], says).collect()] == [(None, True)]


def test_stream_keeps_the_latest_over_replays(spark, tmp_path):
    schema = "k long, at timestamp, v long"
    for n, rows in enumerate([[(1, 10, 1), (2, 5, 2)], [(1, 9, 3), (2, 6, 4)], [(1, 10, 1)]]):
        spark.createDataFrame(rows, "k long, a long, v long").selectExpr("k", "timestamp_seconds(a) AS at", "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = streams.drained(spark, streams.latest(stream, ["k"], "at", "v")).collect()
    assert sorted((r.k, r.v) for r in got) == [(1, 1), (2, 4)]


def batches(spark, tmp_path, rows, schema):
    """A stream that reads one list of rows after another, each in a batch of its own."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        for f in (tmp_path / str(k)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_claims_lapse_unless_confirmed(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    rows = [[("a", at(0), True), ("b", at(0), True), ("c", at(0), True)], [("a", at(3), True), ("b", at(2), False)], [("a", at(6), True), ("b", at(30), True), ("c", at(9), False)], [("a", at(8), True), ("c", at(10), True)]]
    stream = batches(spark, tmp_path, rows, "k string, at timestamp_ntz, c boolean")
    got = sorted((r.k, r.at) for r in streams.drained(spark, streams.claim_ledger(stream, "k", "at", "c"), mode="append").select("k", "at").collect())
    # a: the claim of 12:00 lapses at 12:05; b is confirmed for good; c: a confirmation after the lapse does not count.
    assert got == [("a", at(0)), ("a", at(6)), ("b", at(0)), ("c", at(0)), ("c", at(10))]


def test_rows_later_than_the_horizon_are_dropped(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h, 30)
    rows = [[("x", at(1)), ("x", at(2))], [("x", at(20))], [("x", at(21))], [("x", at(1)), ("x", at(15))], [("x", at(23))]]
    stream = batches(spark, tmp_path, rows, "k string, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.start.hour: r.n for r in streams.drained(spark, streams.tally(stream, "at", "1 hour", "6 hours", ["k"]), mode="append").collect()}
    # The second row of 1:30 comes when the stream has been at 20:30; the one of 15:30 is within six hours of that.
    assert got == {1: 1, 2: 1, 15: 1}
