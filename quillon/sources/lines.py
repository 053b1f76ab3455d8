"""JSON lines: strict reading with a problem list, last key wins, deterministic writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines of a path with `_bad`: the text of a line that does not fit the schema, else null. Blank lines are skipped."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    text = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return text.select(parsed.alias("r")).select("r.*")


def problems(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(problem, says, n): lines that do not parse and keys in more than one line."""
    bad = lines.filter("_bad IS NOT NULL").select(F.lit("unreadable").alias("problem"), F.col("_bad").alias("says"))
    key = F.to_json(F.struct(*keys))
    twice = lines.filter("_bad IS NULL").groupBy(key.alias("says")).count().filter("count > 1").select(F.lit("repeated key").alias("problem"), "says", F.col("count").alias("n"))
    return bad.groupBy("problem", "says").agg(F.count("*").alias("n")).unionByName(twice)


def last_wins(lines: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One line a key, the one at the latest position."""
    w = Window.partitionBy(*keys).orderBy(F.desc(position))
    return lines.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def json_lines(df: DataFrame, columns: list[str], sparse: bool = True) -> DataFrame:
    """(value): each row as JSON with its keys in the order given; sparse leaves null keys out."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": str(sparse).lower()}).alias("value"))


def write_json_lines(df: DataFrame, columns: list[str], order: list[str], path: str, sparse: bool = True) -> None:
    """Writes the lines in order over range partitions: part files follow one another, none is gathered in one task."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    json_lines(placed, columns, sparse).write.mode("overwrite").text(path)
