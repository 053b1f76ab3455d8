"""Web pages as tables: links by expression, records by a parser inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.listing import repaired

RECORD = "page_id bigint, title string, heading string, description string, fields map<string,string>, links array<string>"
SKIPPED = {"script", "style"}


#: An anchor with a href among whatever attributes, in either quotes, and what stands in it, tags included.
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'>]*)["'][^>]*>(.*?)</a>"""


def links(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, position, href, says) of every anchor in page order, what it says without tags and with single spaces; comments
    and scripts hold none; a null page has none."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>", " ")
    anchors = F.arrays_zip(F.regexp_extract_all(plain, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(plain, F.lit(ANCHOR), F.lit(2)).alias("says"))
    one = pages.select(id_, F.posexplode(anchors).alias("position", "a"))
    return one.select(id_, "position", F.col("a.href").alias("href"), F.trim(F.regexp_replace(F.regexp_replace("a.says", "<[^>]*>", " "), "[ \t\n\r]+", " ")).alias("says"))


class _Page(HTMLParser):
    """Collects title, first heading, outermost paragraphs, label and value cells, and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.paragraphs, self.rows, self.links = [], [], [], [], []
        self.into, self.silent = None, 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.silent += 1
        elif tag == "title" and not self.title:
            self.into = self.title
        elif tag == "h1" and not self.heading:
            self.into = self.heading
        elif tag == "p":  # an unclosed paragraph ends where the next begins, so no text is read twice
            self.into = []
            self.paragraphs.append(self.into)
        elif tag == "tr":
            self.rows.append([])
        elif tag == "td" and self.rows:
            self.into = []
            self.rows[-1].append(self.into)
        elif tag == "br" and self.into is not None:
            self.into.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.silent = max(0, self.silent - 1)
        elif tag in ("title", "h1", "p", "td", "article", "div"):
            self.into = None

    def handle_data(self, data):
        if not self.silent and self.into is not None:
            self.into.append(data)


def _clean(parts: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _record(page_id: int, html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    cells = [[_clean(c) for c in row] for row in page.rows if len(row) > 1]
    return page_id, _clean(page.title), _clean(page.heading), "\n".join(t for t in map(_clean, page.paragraphs) if t), {c[0].lower(): c[1] for c in cells}, page.links


def records(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """One record a page: title, first heading, paragraphs one a line, label to value of its table rows, links.

    A null or empty page gives empty fields; of equal labels the last stays; text in scripts and styles is not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "title", "heading", "description", "fields", "links"]
        for b in batches:
            yield pd.DataFrame([_record(i, None if h is None or h != h else h) for i, h in zip(b["i"], b["h"])], columns=names)

    return pages.select(F.col(id_).cast("bigint").alias("i"), F.col(html).alias("h")).mapInPandas(run, RECORD)


#: The layout of a detail page: (tag or "", classes) of its parts, and the label or heading that names what stands in them.
LAYOUT = {
    "title": ("h1", {"header_title"}), "content": ("div", {"template_content"}), "section": ("div", {"section"}), "heading": ("h2", {"section_heading"}),
    "role": ("", {"line", "one"}), "name": ("", {"line", "two"}),
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PARTS = "struct<title:string,cells:array<struct<label:string,value:string>>,sections:array<struct<heading:string,paragraphs:array<string>,items:array<struct<role:string,name:string>>,links:array<string>>>>"


class _Detail(HTMLParser):
    """The parts of a detail page as spans of its pieces of text; a line break is a piece of its own, None.

    An end tag closes all that was opened since its own start, one that nothing opened closes nothing; so a paragraph opened
    inside an unclosed one belongs to that, and only the outermost is kept.
    """

    def __init__(self, layout: dict):
        super().__init__(convert_charrefs=True)
        self.layout, self.pieces, self.open, self.count = layout, [], [], {}
        self.title = None
        self.whole = {"cells": [], "sections": []}  # of the page, for pages without a content part
        self.inside = None
        self.sections, self.rows, self.unread = [], [], {"role": [], "name": []}  # open: sections, rows of less than two cells, items without a part

    def span(self) -> list[int | None]:
        return [len(self.pieces), None]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.pieces.append(None)
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        is_ = {k for k, (t, c) in self.layout.items() if t in ("", tag) and c <= classes}
        span = self.span()
        if "content" in is_ and self.inside is None:
            self.inside = {"cells": [], "sections": [], "span": span}
        places = [self.whole] + [self.inside] * (self.inside is not None and self.inside["span"][1] is None)
        sections, made = list(self.sections), None
        if "title" in is_ and self.title is None:
            self.title = span
        if tag == "tr" and self.count.get("table"):
            made = []
            self.rows.append(made)
            for place in places:
                place["cells"].append(made)
        elif tag == "td":
            for row in self.rows:
                row.append(span)
            self.rows = [row for row in self.rows if len(row) < 2]
        elif tag == "p" and not self.count.get("p"):
            for s in sections:
                s["paragraphs"].append(span)
        elif tag == "li":
            made = {"role": None, "name": None}
            for s in sections:
                s["items"].append(made)
            for unread in self.unread.values():
                unread.append(made)
        elif tag == "a":
            for s in sections:
                s["links"].append(span)
        if "heading" in is_:
            for s in sections:
                s["heading"] = s["heading"] or span
        for part in ("role", "name"):
            if part in is_:
                for item in self.unread[part]:
                    item[part] = span
                self.unread[part] = []
        section = {"heading": None, "paragraphs": [], "items": [], "links": []} if "section" in is_ else None
        if section:
            self.sections.append(section)
            for place in places:
                place["sections"].append(section)
        self.open.append((tag, span, section, made))
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        while self.count.get(tag):
            shut, span, section, made = self.open.pop()
            span[1] = len(self.pieces)
            self.count[shut] -= 1
            if section is not None:
                self.sections.pop()
            if shut == "tr":
                self.rows = [row for row in self.rows if row is not made]
            elif shut == "li":
                self.unread = {k: [i for i in items if i is not made] for k, items in self.unread.items()}
            if shut == tag:
                break

    def handle_data(self, data):
        if not any(self.count.get(t) for t in SKIPPED):
            self.pieces.append(data)

    def text(self, span, line: str = "") -> str | None:
        return None if span is None else "".join(line if p is None else p for p in self.pieces[span[0] : span[1]])

    def parts(self) -> dict:
        at = self.inside or self.whole
        sections = [
            {
                "heading": self.text(s["heading"]),
                "paragraphs": [self.text(p, "\n") for p in s["paragraphs"]],
                "items": [{k: self.text(i[k]) for k in ("role", "name")} for i in s["items"]],
                "links": [self.text(a) for a in s["links"]],
            }
            for s in at["sections"]
        ]
        return {"title": self.text(self.title), "cells": [{"label": self.text(r[0]), "value": self.text(r[1])} for r in at["cells"] if len(r) > 1], "sections": sections}


def parts(pages: DataFrame, id_: str, html: str, layout: dict = LAYOUT) -> DataFrame:
    """(id, parts) of every page: title, cells and sections as they stand, not yet repaired nor cleaned; a null page has none."""
    kind = pages.select(F.col(id_)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = _arrow_parts()
        for batch in batches:
            found = []
            for page in batch.column(1):
                reader = _Detail(layout)
                reader.feed(page.as_py() or "")
                reader.close()
                found.append(reader.parts())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], names=["i", "parts"])

    return pages.select(F.col(id_).alias("i"), F.col(html).alias("h")).mapInArrow(run, f"i {kind}, parts {PARTS}").withColumnRenamed("i", id_)


def _arrow_parts() -> pa.DataType:
    text = pa.string()
    item, cell = pa.struct([("role", text), ("name", text)]), pa.struct([("label", text), ("value", text)])
    section = pa.struct([("heading", text), ("paragraphs", pa.list_(text)), ("items", pa.list_(item)), ("links", pa.list_(text))])
    return pa.struct([("title", text), ("cells", pa.list_(cell)), ("sections", pa.list_(section))])


def _collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def _read(s: Column) -> Column:
    """(text, fixed): repaired, then collapsed; whether the repair changed a text that is kept."""
    mended = repaired(F.coalesce(s, F.lit("")))
    text = _collapsed(mended)
    return F.struct(text.alias("text"), ((text != "") & (mended != F.coalesce(s, F.lit("")))).cast("bigint").alias("fixed"))


def _read_lines(s: Column) -> Column:
    mended = repaired(s)
    text = F.array_join(F.filter(F.transform(F.split(mended, "\n"), _collapsed), lambda line: line != ""), "\n")
    return F.struct(text.alias("text"), ((text != "") & (mended != s)).cast("bigint").alias("fixed"))


def _total(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x["fixed"])


def details(pages: DataFrame, id_: str, html: str, layout: dict = LAYOUT) -> DataFrame:
    """One record a detail page: title, location, date_text, duration_text, description, speakers (name, role), tracks, repaired.

    Of equal labels the last row stays. The description is the first section without a heading that says anything: its
    outermost paragraphs, line breaks kept. All sections headed Speakers add theirs, the last headed Tracks stands. Titles,
    locations, descriptions, tracks and names are repaired before white space is collapsed; `repaired` counts those that the
    repair changed, a description once. A null or empty page gives empty fields.
    """
    named = lambda rows, label: F.try_element_at(F.filter(rows, lambda c: F.lower(_collapsed(c["label"])) == label), F.lit(-1))["value"]
    headed = lambda name: F.filter("parts.sections", lambda s: F.lower(_collapsed(s["heading"])) == name)
    bare = F.filter("parts.sections", lambda s: s["heading"].isNull() | (_collapsed(s["heading"]) == ""))
    said = F.transform(bare, lambda s: F.filter(F.transform(s["paragraphs"], _read_lines), lambda p: p["text"] != ""))
    people = F.flatten(F.transform(headed("speakers"), lambda s: F.transform(s["items"], lambda i: F.struct(_read(i["name"]).alias("name"), _collapsed(i["role"]).alias("role")))))
    tracks = F.transform(F.coalesce(F.try_element_at(headed("tracks"), F.lit(-1))["links"], F.array().cast("array<string>")), _read)
    read = parts(pages, id_, html, layout).select(
        id_, _read(F.col("parts.title")).alias("title"), _read(named(F.col("parts.cells"), "location")).alias("location"),
        _collapsed(named(F.col("parts.cells"), "date")).alias("date_text"), _collapsed(named(F.col("parts.cells"), "duration")).alias("duration_text"),
        F.try_element_at(F.filter(said, lambda p: F.size(p) > 0), F.lit(1)).alias("said"),
        F.filter(people, lambda p: p["name"]["text"] != "").alias("people"), F.filter(tracks, lambda t: t["text"] != "").alias("tracks"),
    )
    said = F.coalesce("said", F.array().cast("array<struct<text:string,fixed:bigint>>"))
    fixed = F.col("title.fixed") + F.col("location.fixed") + F.least(_total(said), F.lit(1)) + _total(F.transform("people", lambda p: p["name"])) + _total(F.col("tracks"))
    return read.select(
        id_, F.col("title.text").alias("title"), F.col("location.text").alias("location"), "date_text", "duration_text",
        F.array_join(F.transform(said, lambda p: p["text"]), "\n").alias("description"),
        F.transform("people", lambda p: F.struct(p["name"]["text"].alias("name"), p["role"].alias("role"))).alias("speakers"),
        F.transform("tracks", lambda t: t["text"]).alias("tracks"), fixed.alias("repaired"),
    )
