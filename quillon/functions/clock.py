"""Zones, days and wording of times as column expressions. No function reads the clock: `now` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import con_day


def instant(local: Column, zone: str) -> Column:
    """The instant of a local time in a zone."""
    return F.to_utc_timestamp(local.cast("string").cast("timestamp"), zone)


def local_day(at: Column, zone: str) -> Column:
    """The day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def in_season(at: Column, zone: str, first: Column, last: Column) -> Column:
    """Whether an instant's local day lies within a span of days."""
    return local_day(at, zone).between(first, last)


def summer_time(local: Column, zone: str, hours: int) -> Column:
    """Whether a zone is so many hours from UTC at a local time: the guard of a fixed offset."""
    at = local.cast("string").cast("timestamp")
    return (F.unix_seconds(at) - F.unix_seconds(F.to_utc_timestamp(at, zone))) == hours * 3600


def later_stamp(a: Column, b: Column) -> Column:
    """The later of two stamps in words with their own offsets, compared as instants; where one cannot be read, the other."""
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return F.when(y.isNull() | (x >= y), a).otherwise(b)


def con_days(first: Column, last: Column) -> Column:
    """Array of struct(day, weekday) from the first con day to the last."""
    return F.transform(F.sequence(con_day(first), con_day(last)), lambda d: F.struct(d.alias("day"), F.date_format(d, "EEEE").alias("weekday")))


def relative_day(word: Column, now: Column) -> Column:
    """The con day that a word names: today, tonight, tomorrow or a weekday (the next one, today's included); else null."""
    today = con_day(now)
    ahead = F.coalesce(*[F.when(F.lower(word) == w, F.pmod(F.lit(k) - F.weekday(today), F.lit(7))) for k, w in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))])
    return F.when(F.lower(word).isin("today", "tonight"), today).when(F.lower(word) == "tomorrow", F.date_add(today, 1)).otherwise(F.date_add(today, ahead))


def spoken(at: Column) -> Column:
    """A wall-clock time in words: noon, midnight, 9 AM or 9:30 AM."""
    hour = F.date_format(at, "h")
    return F.when((F.hour(at) == 12) & (F.minute(at) == 0), "noon").when((F.hour(at) == 0) & (F.minute(at) == 0), "midnight").otherwise(
        F.concat(hour, F.when(F.minute(at) > 0, F.date_format(at, ":mm")).otherwise(""), F.lit(" "), F.when(F.hour(at) < 12, "AM").otherwise("PM"))
    )


def told_duration(minutes: Column) -> Column:
    """`45 min`, `2 h`, or `1 h 30 min`."""
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(hours.cast("string"), F.lit(" h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" min"))).otherwise("")))


def share_day(day: Column, today: Column) -> Column:
    """As an aggregate over days: today's, else the next, else the first."""
    return F.coalesce(F.min(F.when(day >= today, day)), F.min(day))
