"""Wording of schedules as column expressions: dates, durations, ranges, roles, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("MMM d yyyy h:mm a", "MMMM d yyyy h:mm a", "MMM d yyyy HH:mm")


def duration_minutes(s: Column) -> Column:
    """Minutes of `1 hour 30 minutes`, null where neither is stated."""
    of = lambda unit: F.regexp_extract(F.lower(s), rf"(\d+)\s*{unit}", 1).try_cast("int")
    hours, minutes = of("h"), of("m")
    return F.when(hours.isNotNull() | minutes.isNotNull(), F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))


def spoken_time(s: Column, year: Column) -> Column:
    """The moment of `Friday, Sep 4 11:30 AM` in a year, null where no format fits."""
    part = lambda k: F.regexp_extract(F.trim(s), r"^(?:[A-Za-z]+,\s*)?([A-Za-z]+ \d+)\s+(.*)$", k)
    dated = F.concat_ws(" ", part(1), year.cast("string"), part(2))
    return F.coalesce(*[F.try_to_timestamp(dated, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def range_ends(s: Column) -> Column:
    """struct(first, last) of two ends joined by any dash; null ends where there are not two."""
    parts = F.split(s, r"\s*[-–—]\s*")
    two = F.size(parts) == 2
    return F.struct(F.when(two, F.trim(parts[0])).alias("first"), F.when(two, F.trim(parts[1])).alias("last"))


def rolled_end(start: Column, end: Column) -> Column:
    """An end at or before its start is on the next day."""
    return F.when(end <= start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)


def split_role(s: Column) -> Column:
    """struct(name, role): a role in parentheses at the end, taken off the name."""
    role = F.regexp_extract(s, r"\(([^()]*)\)\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(s, r"\s*\([^()]*\)\s*$", "")).alias("name"), F.when(role != "", F.trim(role)).alias("role"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def capped_union(arrays: list[Column], cap: int) -> Column:
    """The values of the arrays in order, each once, at most `cap`; null arrays hold none."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays])), 1, cap)


def mojibake(s: Column) -> Column:
    """Whether UTF-8 text was read as a one-byte charset: a lead byte's letter before a continuation byte's sign."""
    return F.coalesce(s.rlike("[ÂÃ][\u0080-¿]|â€"), F.lit(False))
