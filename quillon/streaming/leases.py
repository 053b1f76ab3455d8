"""Delivery in rounds: what could not be sent is held under a lease and tried again, what cannot ever be is let go.

A round takes the rows that are new and those whose lease runs out with it, sends what its budget allows in order of time, and
learns a verdict a row: `ack` (sent), `hold` (again, under a new lease, until its tries are used up), `prune` (the reader's
address is gone: the reader is pruned, and rows for the reader are dropped from the next round on), `release` (never again).
Rows beyond the budget are put off to the next round without using up a try. Lines of a round are written under its number by
streaming.transaction, so a round that broke off is sent again under the same number with the same rows: a transport that
knows (round, id) repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered

LINES = "id long, reader long, at timestamp_ntz, tries int, state string, until long"
OPEN = ("held", "waiting")


def due(new: DataFrame, lines: DataFrame, number: int) -> DataFrame:
    """(id, reader, at, tries): new rows, and those of the last round's lines whose lease ends now. Lines of older rounds are
    not read: a row that is still open has a line in the last one."""
    again = lines.filter((F.col("batch") == number - 1) & F.col("state").isin(*OPEN)).select("id", "reader", "at", "tries", "until")
    return new.select("id", "reader", "at", F.lit(0).alias("tries"), F.lit(number).cast("long").alias("until")).unionByName(again)


def round_of(rows: DataFrame, pruned: DataFrame, number: int, verdict: Column, tries: int = 3, wait: int = 1, budget: int | None = None) -> DataFrame:
    """The lines of a round (LINES). pruned: (reader). verdict: ack, hold, prune or release by the columns id, reader and tries
    (those used before). budget: rows sent at most, earliest first; None for all."""
    known = rows.join(pruned.select("reader").distinct().withColumn("_gone", F.lit(True)), "reader", "left")
    ripe = known.withColumn("_try", F.col("_gone").isNull() & (F.col("until") <= number))
    if budget is None:
        placed = ripe.withColumn("_r", F.lit(0))
    else:
        placed = numbered(ripe, [F.col("_try").desc(), F.col("at"), F.col("id")], "_r").withColumn("_r", F.when(F.col("_r") > budget, 1).otherwise(0))
    send = F.col("_try") & (F.col("_r") == 0)
    used = F.col("tries") + F.when(send, 1).otherwise(0)
    state = F.when(F.col("_gone"), "dropped").when(~send, "waiting").when(verdict == "ack", "sent").when(verdict == "prune", "pruned").when(verdict == "release", "released").when(used >= tries, "expired").otherwise("held")
    until = F.when(state == "held", F.lit(number + wait)).when(state == "waiting", F.greatest(F.col("until"), F.lit(number + 1))).cast("long")
    return placed.select("id", "reader", "at", used.cast("int").alias("tries"), state.alias("state"), until.alias("until"))
