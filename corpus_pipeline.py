"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, language_id, mixing, ngram_join, sharding
from quillon.llm._common import small_batches, written

SHARDS = 16


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no text, no letter in it, or a text that no learned language parses in
    fewer bits than its bytes have (random letters, a script that no sample holds).

    Null text goes; null ids, null languages and repeated rows stay as they are; ties between languages do not matter here;
    where no row has a language, all texts with a letter stay; an empty table stays empty; all columns pass through, and
    those made on the way begin with `_q_`.
    """
    small_batches(spark)
    samples = language_id.learn(docs)
    if not samples:  # every document would be of no known language
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    marked = language_id.predict(docs, samples, lang_out="_q_lang", score_out="_q_score", fits_out="_q_fits")
    return marked.filter((F.col("_q_lang") != language_id.UND) & F.col("_q_fits")).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays: the one with the smallest doc_id.

    Rows without words and rows without an id are in no group and stay; rows that repeat an id are one document, and all of
    them stay or go; ties cannot arise, ids decide; an empty table stays empty; all columns pass through.
    """
    found = ngram_join.near_documents(docs, name="pipeline-ngrams")
    gone = written(found.filter("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    gone = F.broadcast(gone) if gone.count() <= ngram_join.BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and wordless texts contain none and stay; null ids and repeated rows are judged by their texts alone; null and
    repeated items do no harm; with no items, or no documents, nothing changes; all columns pass through.
    """
    small_batches(spark)
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or are left out, as their source's weight asks.

    A null source is a source of its own; a source without words gives nothing; null texts have no words and share their
    source's rate; equal rows share one coin; an empty table stays empty; all columns pass through.
    """
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot.

    Null ids are placed by their text, repeated rows share a place on the ring; an empty table stays empty; columns shard
    and slot of the input give way, all others pass through.
    """
    return sharding.shard(docs, SHARDS).drop("_q_size")


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language identification is not expressible in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
