"""Time scalars as column expressions. No function reads the clock: `now` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def con_day(ts: Column, hours: int = 5) -> Column:
    """The day a session counts to: nights belong to the day before."""
    return F.to_date(ts - F.expr(f"INTERVAL {hours} HOURS"))


def band_hour(ts: Column, hours: int = 5) -> Column:
    """Hour of the con day: hours after midnight count on from 24."""
    return F.hour(ts) + F.when(F.hour(ts) < hours, 24).otherwise(0)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, up to the next one."""
    return F.ceil((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 60_000_000).cast("bigint")


def phase(now: Column, first: Column, last: Column) -> Column:
    """before, live or ended."""
    return F.when(now < first, "before").when(now > last, "ended").otherwise("live")
