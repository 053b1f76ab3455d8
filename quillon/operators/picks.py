"""Picks kept by their readers: what devices send is merged into what is stored, nothing is ever deleted, days that hold a pick
are listed, and lists are dealt in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def merged(stored: DataFrame, incoming: DataFrame, keys: list[str], stamp: str, fields: list[str], now: Column, grace: str = "5 minutes") -> DataFrame:
    """(keys, stamp, fields, came): the stored rows with what came in. A stamp beyond now and the grace is set back to that; of
    several rows of a key the latest counts, of equal stamps the one with larger fields; it replaces a stored row only where it
    is strictly later, so a replay changes nothing. Keys are never changed: they say which row it is. A row that takes a pick
    back (picked = false) is a row like others, a tombstone, and outlives what is sent late.

    Incoming rows are reduced by key before the join, so a key that is sent again and again is one row there. A null key is a
    key; a null stamp is earlier than all others; columns of other names are left out.
    """
    sent = incoming.select(*keys, F.when(F.col(stamp).isNotNull(), F.least(F.col(stamp), now + F.expr(f"INTERVAL {grace}"))).alias(stamp), *fields)
    best = sent.groupBy(*keys).agg(F.max(F.struct(stamp, *fields)).alias("_in"))
    held = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(stamp, *fields).alias("_held"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = best.join(held, same, "full")
    later = F.col("_in").isNotNull() & (F.col("_held").isNull() | F.coalesce(F.col(f"_in.{stamp}") > F.col(f"_held.{stamp}"), F.col(f"_in.{stamp}").isNotNull() & F.col(f"_held.{stamp}").isNull()))
    won = F.when(later, F.col("_in")).otherwise(F.col("_held"))
    # A key's columns stand on one side at least; which one is told by the structs, as keys may be null.
    chosen = [F.when(F.col("_in").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*chosen, won.alias("_row"), later.alias("came")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (stamp, *fields)], "came")


def live(picks: DataFrame, picked: str = "picked") -> DataFrame:
    """The picks that stand: tombstones are left out when they are read, not when they are kept."""
    return picks.filter(F.col(picked))


def held_days(picks: DataFrame, schedule: DataFrame, reader: str, item: str, day: str, out: Column) -> DataFrame:
    """(reader, day, n): con days that hold a pick of the reader that is in the schedule and not out (removed, cancelled)."""
    there = schedule.filter(~F.coalesce(out, F.lit(False))).select(item, day)
    return live(picks).join(there, item).groupBy(reader, day).agg(F.count_distinct(item).alias("n"))


def opening_day(days: DataFrame, reader: str, day: str, today: Column) -> DataFrame:
    """(reader, day): today if it holds a pick, else the next day that does, else the first."""
    coming = F.min(F.when(F.col(day) >= today, F.col(day)))
    return days.groupBy(reader).agg(F.coalesce(coming, F.min(day)).alias(day))


def dealt(rows: DataFrame, name: str, order: list[Column], item: str) -> DataFrame:
    """(item, name, r): lists merged in turn, the first of each (in order of names), then the second of each, ...; an item
    comes once, where it comes first. Places come from ranges, so that a list of all rows is no task of its own; null items are
    left out."""
    placed = numbered(rows.filter(F.col(item).isNotNull()), [F.col(name), *order], "_r")
    low = placed.groupBy(F.col(name).alias("_name")).agg(F.min("_r").alias("_low"))
    turns = placed.join(low, F.col(name).eqNullSafe(F.col("_name"))).select(item, name, (F.col("_r") - F.col("_low")).alias("_turn"))
    first = turns.groupBy(item).agg(F.min(F.struct("_turn", name)).alias("_f")).select(item, f"_f.{name}", "_f._turn")
    return numbered(first, [F.col("_turn"), F.col(name), F.col(item)], "r").select(item, name, "r")
