"""Calendar entries as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped
from ..operators.ordered import numbered

WIDTH = 74  # characters a line may have before it is folded
#: Standard and daylight time of a zone (name, offset), and when they begin (month, day, hour) in every year.
ZONES = {"America/New_York": {"STANDARD": ("EST", "-0500", "11", "1SU"), "DAYLIGHT": ("EDT", "-0400", "3", "2SU")}}


def folded(line: Column) -> Column:
    """A content line cut into pieces of WIDTH characters, those after the first led by a space; null of null."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)), F.lit(WIDTH))
    return F.when(line.isNotNull(), F.array_join(F.transform(starts, lambda k: F.substr(line, k, F.lit(WIDTH))), "\r\n "))


def entries(df: DataFrame, id_: str, title: str, start: str, end: str, place: str, zone: str) -> DataFrame:
    """(id, value): one VEVENT a row in wall-clock time of the zone; null fields are left out."""
    at = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    lines = F.array(
        F.lit("BEGIN:VEVENT"),
        folded(F.concat(F.lit("UID:"), F.col(id_).cast("string"))),
        folded(F.concat(F.lit(f"DTSTART;TZID={zone}:"), at(start))),
        folded(F.concat(F.lit(f"DTEND;TZID={zone}:"), at(end))),
        folded(F.concat(F.lit("SUMMARY:"), escaped(F.col(title)))),
        folded(F.concat(F.lit("LOCATION:"), escaped(F.col(place)))),
        F.lit("END:VEVENT"),
    )
    return df.select(id_, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\r\n").alias("value"))


def zone_lines(zone: str) -> list[str]:
    """The VTIMEZONE block of a zone, whose two times begin at two in the morning."""
    out = ["BEGIN:VTIMEZONE", f"TZID:{zone}"]
    for kind, other in (("DAYLIGHT", "STANDARD"), ("STANDARD", "DAYLIGHT")):
        name, offset, month, day = ZONES[zone][kind]
        first = {"2SU": "0308", "1SU": "1101"}[day]  # the Sundays of 2020, from which the rules count
        out += [f"BEGIN:{kind}", f"TZOFFSETFROM:{ZONES[zone][other][1]}", f"TZOFFSETTO:{offset}", f"TZNAME:{name}", f"DTSTART:2020{first}T020000", f"RRULE:FREQ=YEARLY;BYMONTH={month};BYDAY={day}", f"END:{kind}"]
    return [*out, "END:VTIMEZONE"]


def file_lines(made: DataFrame, order: list[Column], zone: str, maker: str) -> DataFrame:
    """(line, value): a whole calendar, its head with the zone at 0, then the entries (column value) in order, then its end.
    Written sorted by line, the values joined by line breaks are the file."""
    head = "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{maker}", "CALSCALE:GREGORIAN", *zone_lines(zone)])
    placed = numbered(made, order, "line")
    ends = placed.agg(F.coalesce(F.max("line"), F.lit(0)).alias("n"))
    outer = ends.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit(head).alias("value")), F.struct((F.col("n") + 1).alias("line"), F.lit("END:VCALENDAR").alias("value")))).alias("x"))
    return placed.select("line", "value").unionByName(outer.select("x.line", "x.value"))
