"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id of the edges (a, b); component is the smallest id reachable.

    Each round points every node at its smallest neighbour, follows pointers to roots, and replaces nodes by their
    roots, until no edge is left. Every round is a table in the shared folder; the driver sees only counts.
    """
    forward = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, mapping, rounds = written(forward, f"{name}-edges"), None, 0
    while mapping is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("parent")), f"{name}-parents")
        while True:
            up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            raised = parents.join(up, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
            raised = written(raised, f"{name}-parents")
            parents = raised.select("id", "parent")
            if raised.filter("moved").isEmpty():
                break
        if mapping is None:
            mapping = parents.select("id", F.col("parent").alias("component"))
        else:
            roots = parents.select(F.col("id").alias("component"), F.col("parent").alias("root"))
            mapping = mapping.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        mapping = written(mapping, f"{name}-map")
        one = parents.select(F.col("id").alias("a"), F.col("parent").alias("ra"))
        two = parents.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
        left = edges.join(one, "a").join(two, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct()
        edges, rounds = written(left, f"{name}-edges"), rounds + 1
    return mapping
