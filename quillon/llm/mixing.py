"""Mixing sources to target weights.

Words per source are aggregated once; water-filling over the (few) source rows gives targets and repetition rates;
each document is then emitted floor(rate) times plus one Bernoulli copy whose coin is a seeded hash of its id.

Defined cases: a null text has size 0; a null source is a source of its own and sorts last; a null doc_id and repeated
rows take their coin from id and text, so equal rows share one; an empty table gives an empty result; a source without
words has rate 0; other columns pass through, and the working columns have names of their own that begin with `_q_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, written

#: Weights by rank of the source's name, repeating.
WEIGHTS = (5, 2, 1)
#: Up to this many source rows (a few MB) are broadcast; more are joined by shuffle, where adaptive execution splits hot ones.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of words of the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row a source: size, target and rate.

    A target stops at `most` times the source's size; what it leaves goes to the others by weight. That is the level L
    with sum(min(most * size, L * weight)) = share * total: sources sorted by most * size / weight are full up to some
    rank, and prefix sums give L for each rank. `sizes` holds one row per source, as many as there are source names.
    """
    total = sizes.agg(F.sum(size).alias("_q_total"))
    ranked = sizes.withColumn("_q_rank", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_q_rank") % len(weights) + 1).cast("int"))
    cap = F.col(size) * F.lit(float(most))
    ranked = ranked.withColumns({"_q_weight": weight, "_q_cap": cap}).withColumn("_q_ratio", F.col("_q_cap") / F.col("_q_weight"))
    order = Window.orderBy("_q_ratio", "_q_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.col("_q_total") - F.coalesce(F.sum("_q_cap").over(before), F.lit(0.0))) / F.sum("_q_weight").over(rest)
    leveled = ranked.crossJoin(total).withColumn("_q_level", level)  # the total is one row
    # The first source in this order whose ratio is above its level sets the level of all that follow.
    water = F.min(F.when(F.col("_q_level") <= F.col("_q_ratio"), F.struct("_q_ratio", "_q_rank", "_q_level"))).over(Window.partitionBy())
    target = F.least("_q_cap", F.coalesce(water["_q_level"], F.lit(float("inf"))) * F.col("_q_weight"))
    target = F.when(F.col(size) > 0, target).otherwise(0.0)
    return leveled.select(source, F.col(size).alias("_q_source_size"), target.alias("_q_target"), F.when(F.col(size) > 0, target / F.col(size)).otherwise(0.0).alias("_q_rate"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The documents with `_q_size`, their source's `_q_source_size`, `_q_target` and `_q_rate`, and `_q_copies` to emit."""
    sized = docs.withColumn("_q_size", word_count(F.col(text)))
    per_source = sized.groupBy(F.col(source).alias("_q_source")).agg(F.sum("_q_size").alias("_q_words"))
    targets = source_targets(per_source, "_q_source", "_q_words", share, most, weights)
    targets = written(targets, "mix-targets")  # one row a source; the words are counted once
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("_q_source")), "left").drop("_q_source")
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    coin = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = F.floor("_q_rate") + (coin < F.col("_q_rate") - F.floor("_q_rate")).cast("long")
    return joined.withColumn("_q_copies", copies)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as often as its plan says, with the columns of the input."""
    planned = mix_plan(docs, **how).filter("_q_copies > 0")
    return planned.withColumn("_q_copy", F.explode(F.array_repeat(F.lit(0), F.col("_q_copies").cast("int")))).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", F.col("_q_size").alias("size"), F.col("_q_source_size").alias("source_size"), F.col("_q_target").alias("target"), (F.col("_q_size") * F.col("_q_copies")).alias("taken"), F.col("_q_copies").alias("copies"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)] AS weight,
         words * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM per),
leveled AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * (SELECT sum(words) FROM per) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
water AS (SELECT arg_min(level, (ratio, rk)) AS level FROM leveled WHERE level <= ratio),
targets AS (
  SELECT source, words, CASE WHEN words > 0 THEN least(cap, coalesce((SELECT level FROM water), 'infinity'::DOUBLE) * weight) ELSE 0.0 END AS target FROM leveled),
rated AS (
  SELECT s.doc_id, s.size, t.words AS source_size, t.target, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, md5(coalesce(s.text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) AS taken,
       floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT AS copies FROM rated
"""
