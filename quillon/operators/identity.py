"""Stable identities across snapshots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def two_of_three(gone: DataFrame, new: DataFrame, id_: str, key: list[str]) -> DataFrame:
    """(gone, new) that agree in all but one part of the key at least: one equality join for each choice of parts, no cross join.

    A pair that agrees in every part is taken from the first choice only, so the joins share no pair of rows and no pair is
    shuffled. Only ids that stand in several rows can give a pair twice; theirs alone are made distinct.
    """
    tasks = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(F.col(id_).alias(name), *key).distinct().withColumn("_n", F.count("*").over(Window.partitionBy(name)))
        return rows.filter("_n = 1").drop("_n"), rows.filter("_n > 1").drop("_n")

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        out = None
        for parts in combinations(key, len(key) - 1):
            (left,) = set(key) - set(parts)
            # The pairs are the work, not the rows: tasks are not to be put together for having few of those.
            both = a.repartition(tasks, *parts).join(b.withColumnRenamed(left, "_other"), list(parts))
            if out is not None:
                both = both.filter(~F.coalesce(F.col(left) == F.col("_other"), F.lit(False)))
            out = both.select("gone", "new") if out is None else out.unionByName(both.select("gone", "new"))
        return out

    (a, a_again), (b, b_again) = side(gone, "gone"), side(new, "new")
    found = pairs(a, b)
    if not (a_again.isEmpty() and b_again.isEmpty()):
        found = found.unionByName(pairs(a_again, b.unionByName(b_again)).unionByName(pairs(a, b_again)).distinct())
    return found


def new_ids(groups: DataFrame, ledger: DataFrame, source: str, group: str, id_: str) -> DataFrame:
    """(group, id, merged) where groups of source ids meet a ledger (source, id): the smallest id known to the group stays,
    others are listed as merged into it; a group without a known one takes its smallest source id."""
    known = groups.join(ledger.select(source, id_), source, "left").groupBy(group).agg(F.min(id_).alias("kept"), F.array_sort(F.collect_set(id_)).alias("ids"), F.min(source).alias("smallest"))
    kept = F.coalesce("kept", F.col("smallest").cast("string"))
    return known.select(group, kept.alias(id_), F.filter("ids", lambda x: x != F.col("kept")).alias("merged"))


def split_lines(claims: DataFrame, id_: str, group: str, size: str, smallest: str) -> DataFrame:
    """Claims of groups on ledger ids with `new_id`: the largest group keeps the id, then the one with the smallest source;
    the others get the id with a number, in that order."""
    rank = F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(size), smallest, group))
    return claims.withColumn("_n", rank).withColumn("new_id", F.concat_ws(".", F.col(id_).cast("string"), F.when(F.col("_n") > 1, (F.col("_n") - 1).cast("string")))).drop("_n")
