"""Queries of the reference's operator families over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cdc
from .catalog import query, table

_EDITS = """
WITH prev AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders WHERE o_orderkey % 101 <> 7),
cur AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 3 THEN 'X' ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 37 = 5 THEN NULL ELSE o_orderpriority END AS priority, o_totalprice AS price FROM orders WHERE o_orderkey % 103 <> 9)
"""
DIFF_FIELDS = {"status": "status", "priority": "priority"}


def order_versions(spark, sf_dir):
    """Two snapshots of orders: rows dropped, added and edited by rule."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    previous = o.filter("id % 101 <> 7")
    current = o.filter("id % 103 <> 9").withColumns({"status": F.when(F.col("id") % 23 == 3, "X").otherwise(F.col("status")), "priority": F.when(F.col("id") % 37 != 5, F.col("priority"))})
    return previous, current


@query(
    "snapshot_diff",
    _EDITS
    + """
SELECT coalesce(p.id, c.id) AS id, k.kind, CASE k.kind WHEN 'status' THEN p.status WHEN 'priority' THEN p.priority END AS from_value,
       CASE k.kind WHEN 'status' THEN c.status WHEN 'priority' THEN c.priority END AS to_value
FROM prev p FULL JOIN cur c ON p.id = c.id CROSS JOIN (VALUES ('added'), ('removed'), ('status'), ('priority')) k(kind)
WHERE (k.kind = 'added' AND p.id IS NULL) OR (k.kind = 'removed' AND c.id IS NULL)
   OR (p.id IS NOT NULL AND c.id IS NOT NULL AND ((k.kind = 'status' AND p.status IS DISTINCT FROM c.status) OR (k.kind = 'priority' AND p.priority IS DISTINCT FROM c.priority)))
""",
)
def snapshot_diff(spark, sf_dir):
    return cdc.snapshot_diff(*order_versions(spark, sf_dir), "id", DIFF_FIELDS)
