"""Data-quality gates: collect-all problem lists, exact thresholds, uniqueness, references."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key, n_rows) of all broken rules: one pass, every rule of every row. A rule is true where the row is good."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).groupBy("rule", "key").agg(F.count("*").alias("n_rows"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_references(df: DataFrame, key: str, column: str, dimension: DataFrame, target: str) -> DataFrame:
    """(key, missing): rows whose reference no dimension row has."""
    return df.filter(F.col(column).isNotNull()).select(key, F.col(column).alias("missing")).join(dimension.select(F.col(target).alias("missing")).distinct(), "missing", "left_anti").select(key, "missing")


def alias_collisions(names: DataFrame, key: Column, id_: str) -> DataFrame:
    """(key, ids): normalised names that several entries claim."""
    return names.select(key.alias("key"), F.col(id_).alias("id")).groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def share_gate(part: DataFrame, whole: DataFrame, share: Decimal) -> DataFrame:
    """One row: n, whole and whether n <= share * whole, in exact decimals."""
    return part.agg(F.count("*").alias("n")).crossJoin(whole.agg(F.count("*").alias("whole"))).withColumn("passes", F.col("n").cast("decimal(20,6)") <= F.col("whole").cast("decimal(20,0)") * F.lit(share))  # one row by one row


def digest(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row: n and a digest of all rows that neither row order nor partitioning changes.

    Each row's hash covers its canonical JSON; the hashes are added up as four 32-bit parts, so nothing is gathered.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("digest"))


def all_of(*conditions: Column) -> Column:
    """The conjunction of filters; none keeps every row."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
