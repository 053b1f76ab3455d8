"""Parent forests: closure by repeated joins, counts through ancestors, most specific nodes, ends of chains."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(nodes: DataFrame, id_: str = "id", parent: str = "parent") -> DataFrame:
    """(id, ancestor, depth), every node its own ancestor at depth 0, the depth the least there is.

    Path doubling: a round doubles the depth reached; rounds end when one adds no pair, however deep the forest is. On a ring
    every node is an ancestor of every other.
    """
    edges = nodes.filter(F.col(parent).isNotNull()).select(F.col(id_).alias("id"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct()
    reach = settled(edges)
    held, more = reach.count(), True
    while more:
        left = reach.select("id", F.col("ancestor").alias("mid"), F.col("depth").alias("d1"))
        right = reach.select(F.col("id").alias("mid"), "ancestor", F.col("depth").alias("d2"))
        longer = left.join(right, "mid").select("id", "ancestor", (F.col("d1") + F.col("d2")).alias("depth"))
        reach = settled(reach.unionByName(longer).filter("id <> ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        found = reach.count()
        more, held = found > held, found
    return reach.unionByName(nodes.select(F.col(id_).alias("id"), F.col(id_).alias("ancestor"), F.lit(0).alias("depth")).distinct())


def rolled_up(facts: DataFrame, closed: DataFrame, node: str, item: str) -> DataFrame:
    """(node, n): distinct items at or below each node."""
    return facts.join(closed.select(F.col("id").alias(node), "ancestor"), node).groupBy(F.col("ancestor").alias("node")).agg(F.count_distinct(item).alias("n"))


def most_specific(links: DataFrame, closed: DataFrame, item: str, node: str) -> DataFrame:
    """Links without those to an ancestor of another node that the item is linked to."""
    above = links.join(closed.filter("depth > 0").select(F.col("id").alias(node), "ancestor"), node).select(item, F.col("ancestor").alias(node)).distinct()
    return links.join(above, [item, node], "left_anti")


def settled(df: DataFrame) -> DataFrame:
    """The rows without their lineage, in the folder that spark.checkpoint.dir names; where it is unset, which only a local
    session may leave so, in a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-marks-"))
    return df.checkpoint()


def ends(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, to) with `to` where the links (id, to) end, and the nodes of rings where there are any. A round doubles the jumps
    until nothing moves; after more jumps than there are links only what leads into a ring still does."""
    reach = links
    for _ in range(links.count().bit_length() + 1):
        step = reach.select(F.col("id").alias("to"), F.col("to").alias("next"))
        raised = settled(reach.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        reach = raised.select("id", "to")
        if raised.filter("moved").isEmpty():
            return reach, None
    return reach, raised.filter("moved").select(F.col("to").alias("id")).distinct()


def resolved(ledger: DataFrame, id_: str = "id", into: str = "merged_into") -> DataFrame:
    """(id, survivor): every id with the id its chain of merges ends in, however long. A ring has no end: its ids stay
    as they are, and a chain that leads into it ends where it meets it."""
    links = settled(ledger.filter(F.col(into).isNotNull()).groupBy(F.col(id_).alias("id")).agg(F.max(into).alias("to")))
    found, ring = ends(links)
    if ring is not None:
        found, _ = ends(links.join(ring, "id", "left_anti"))
    return ledger.select(F.col(id_).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("to", "id").alias("survivor"))
