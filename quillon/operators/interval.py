"""Intervals and as-of lookups: overlaps by day buckets, islands, concurrency, neighbours, connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_pairs(df: DataFrame, key: str, id_: str, start: str, end: str, bucket: str = "hour") -> DataFrame:
    """(key, a, b, seconds) of overlapping intervals of a key, each pair once (a begins first).

    Intervals are put into the time buckets they touch, so the join is by equality; a pair counts in the bucket where its
    later interval begins.
    """
    unit = {"hour": 3600, "day": 86400}[bucket]
    rows = df.select(key, F.col(id_).alias("i"), F.unix_micros(F.col(start).cast("timestamp")).alias("s"), F.unix_micros(F.col(end).cast("timestamp")).alias("e")).filter("e > s")
    width = unit * 1_000_000
    first = rows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    second = rows.select(F.col(key).alias("k2"), F.col("i").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.floor(F.col("s") / width).alias("slot2"))
    pair = (F.col(key) == F.col("k2")) & (F.col("slot") == F.col("slot2")) & (F.col("s2") < F.col("e")) & ((F.col("s") < F.col("s2")) | ((F.col("s") == F.col("s2")) & (F.col("i") < F.col("b"))))
    return first.join(second, pair).select(key, F.col("i").alias("a"), "b", ((F.least("e", "e2") - F.col("s2")) / 1_000_000).cast("bigint").alias("seconds"))


def islands(df: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """The rows with `island`: intervals of a key whose overlaps connect them, numbered from 1."""
    w = Window.partitionBy(key).orderBy(start, order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0)
    return df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("fresh")


def peak_concurrency(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, peak): most intervals at one moment; an end comes before a start of the same moment."""
    edges = df.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x")).select(key, "x.at", "x.d")
    edges = edges.groupBy(key, "at").agg(F.sum(F.when(F.col("d") < 0, -1).otherwise(0)).alias("out"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("in"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("open", F.sum(F.col("out") + F.col("in")).over(w)).groupBy(key).agg(F.max("open").cast("bigint").alias("peak"))


def with_neighbours(df: DataFrame, key: list[str], start: str, tie: str, carry: list[str]) -> DataFrame:
    """Adds prev_<c> and next_<c> of the row before and after within the key."""
    w = Window.partitionBy(*key).orderBy(start, tie)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in carry} | {f"next_{c}": F.lead(c).over(w) for c in carry})


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: str, tie: str) -> DataFrame:
    """Left rows with the value of the latest right row at or before them (null without one): one sort, no range join."""
    a = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[tie].dataType).alias("_t"))
    b = right.select(*[F.col(c) for c in by], F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(tie).alias("_t"))
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_t").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"as_of_{value}", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, f"as_of_{value}")


def connection(gap: Column, walk: Column) -> Column:
    """How two sessions connect: overlap, cant (no time to walk), tight (less than ten minutes over), else null."""
    return F.when(gap < 0, "overlap").when(gap < walk, "cant").when(gap < walk + 10, "tight")


def symmetric_lookup(pairs: DataFrame, table: DataFrame, a: str, b: str, value: str, default: int) -> DataFrame:
    """Pairs with the value stored for either order of the two; 0 for equal ends, else the default."""
    keyed = table.select(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"), F.col(value).alias("_value"))
    found = pairs.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)}).join(keyed, ["_lo", "_hi"], "left")
    return found.withColumn(value, F.when(F.col(a) == F.col(b), 0).otherwise(F.coalesce("_value", F.lit(default)))).select(*pairs.columns, value)


def stretches(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, first, last, n) of each run of an unchanged value."""
    w = Window.partitionBy(key).orderBy(order)
    moved = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("m", moved).withColumn("run", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", value).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count("*").alias("n")).drop("run")
