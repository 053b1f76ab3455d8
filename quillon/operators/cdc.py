"""Snapshot comparison and change data capture."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Change lines (id, kind, from_value, to_value) between two snapshots with the same columns.

    fields: kind -> column compared. Rows only in one snapshot give `added` or `removed`. One full outer join on the key;
    the lines of a row come from one array, so there is a single shuffle of each side.
    """
    cols = list(dict.fromkeys(fields.values()))
    old = previous.select(F.col(key).alias("id"), F.struct(*cols).alias("o"))
    new = current.select(F.col(key).alias("id"), F.struct(*cols).alias("n"))
    joined = old.join(new, "id", "full_outer")
    line = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("from_value"), b.cast("string").alias("to_value"))
    none = F.lit(None)
    changed = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), line(kind, F.col(f"o.{c}"), F.col(f"n.{c}"))) for kind, c in fields.items()]
    lines = F.when(F.col("o").isNull(), F.array(line("added", none, none))).when(F.col("n").isNull(), F.array(line("removed", none, none))).otherwise(F.array(*changed))
    return joined.select("id", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("id", "l.kind", "l.from_value", "l.to_value")


def attribute_cause(lines: DataFrame, counterfactual: DataFrame, current: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Adds cause: `code` where a build of the old inputs by the new code already shows the new value, else `source`."""
    cols = list(dict.fromkeys(fields.values()))
    a = counterfactual.select(F.col(key).alias("id"), F.struct(*cols).alias("c"))
    b = current.select(F.col(key).alias("id"), F.struct(*cols).alias("n"))
    agrees = F.lit(False)
    for kind, c in fields.items():
        agrees = F.when(F.col("kind") == kind, F.col(f"c.{c}").eqNullSafe(F.col(f"n.{c}"))).otherwise(agrees)
    present = F.when(F.col("kind") == "added", F.col("c").isNotNull()).when(F.col("kind") == "removed", F.col("c").isNull()).otherwise(F.col("c").isNotNull() & agrees)
    return lines.join(a, "id", "left").join(b, "id", "left").withColumn("cause", F.when(present, "code").otherwise("source")).drop("c", "n")


def carry_forward(previous: DataFrame, listed: DataFrame, key: str, failed: Column) -> DataFrame:
    """The listed rows, `stale` previous rows for listed keys that failed, and `removed` previous rows no longer listed.

    failed: over the listed columns, true where the row could not be read again.
    """
    cols = [c for c in previous.columns if c != key]
    old = previous.select(key, F.struct(*cols).alias("o"))
    new = listed.select(key, F.struct(*cols).alias("n"), failed.alias("failed"))
    both = old.join(new, key, "full_outer")
    state = F.when(F.col("n").isNull(), "removed").when(F.col("failed") & F.col("o").isNotNull(), "stale").when(~F.col("failed"), "fresh")
    row = F.when(F.col("n").isNull() | F.col("failed"), F.col("o")).otherwise(F.col("n"))
    return both.withColumn("state", state).filter("state IS NOT NULL").select(key, row.alias("r"), "state").select(key, *[F.col(f"r.{c}").alias(c) for c in cols], "state")


def latest_stamp_wins(rows: DataFrame, keys: list[str], stamp: str, now: Column | None = None, future: str = "5 minutes", tie: list[str] | None = None) -> DataFrame:
    """One row a key: the one with the latest stamp, stamps beyond now + future clamped to it; of equal stamps the first by
    the tie columns stays."""
    at = F.col(stamp) if now is None else F.least(F.col(stamp), now + F.expr(f"INTERVAL {future}"))
    order = Window.partitionBy(*keys).orderBy(F.desc("_at"), *[F.col(c).asc() for c in tie or []])
    return rows.withColumn("_at", at).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").withColumn(stamp, F.col("_at")).drop("_at")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key the source lacks, and the source's rows."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def reconcile(was: DataFrame, now: DataFrame, key: str, at: str, room: str, cancelled: str) -> DataFrame:
    """(key, kind) of what changed under a reader's picks: gone, cancelled, moved, room; one line each, in that priority."""
    both = was.select(key, F.struct(at, room).alias("w")).join(now.select(key, F.struct(at, room, cancelled).alias("n")), key, "left")
    kind = F.when(F.col("n").isNull(), "gone").when(F.col(f"n.{cancelled}"), "cancelled").when(~F.col(f"w.{at}").eqNullSafe(F.col(f"n.{at}")), "moved").when(~F.col(f"w.{room}").eqNullSafe(F.col(f"n.{room}")), "room")
    return both.select(key, kind.alias("kind")).filter("kind IS NOT NULL")


def changed_since(rows: DataFrame, passed: DataFrame, stamp: str, overlap: str) -> DataFrame:
    """Rows later than the mark of what has been read, less an overlap that is read again."""
    mark = passed.agg((F.max(stamp) - F.expr(f"INTERVAL {overlap}")).alias("_mark"))
    return rows.join(F.broadcast(mark), F.col(stamp) > F.col("_mark")).drop("_mark")  # one row
