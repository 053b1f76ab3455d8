"""Streams: the latest row of a key, first claims, tallies with late rows dropped, notices folded by reader."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; in local mode, where it is unset, under the temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def latest(stream: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """The row with the latest stamp of each key, the larger tie column among equals: a replay changes nothing."""
    rest = [c for c in stream.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(stamp, tie)).alias("r")
    return stream.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def first_claims(stream: DataFrame, keys: list[str], stamp: str, hold: str = "5 minutes") -> DataFrame:
    """The first row of a key; the claim on it lapses once the stream is `hold` past it."""
    return stream.withWatermark(stamp, hold).dropDuplicatesWithinWatermark(keys)


def claim_ledger(stream: DataFrame, key: str, at: str, is_claim: str, hold: str = "5 minutes") -> DataFrame:
    """(key, at): claims that are granted, in a stream of claims and confirmations (is_claim false): a key that is free, or
    whose claim was not confirmed within `hold`, which has lapsed then. A confirmed key is never free again. The state of a
    key is when it was claimed and whether that was confirmed; rows of one batch are taken in order of time."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    span = pd.Timedelta(hold)

    def step(keys, batches, state: GroupState):
        claimed, sent = state.get if state.exists else (None, False)
        granted = []
        for row in pd.concat(list(batches)).sort_values([at, is_claim], kind="stable").itertuples(index=False):
            now = getattr(row, at)
            if getattr(row, is_claim):
                if claimed is None or (not sent and now > pd.Timestamp(claimed) + span):
                    claimed, sent = now.isoformat(), False
                    granted.append(now)
            elif claimed is not None:
                sent = sent or now <= pd.Timestamp(claimed) + span
        if claimed is not None:
            state.update((claimed, sent))
        yield pd.DataFrame({key: [keys[0]] * len(granted), at: pd.Series(granted, dtype="datetime64[ns]")})

    rows = stream.select(key, F.col(at).cast("timestamp_ntz").alias(at), is_claim)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {at} timestamp_ntz", "claimed string, sent boolean", "append", "NoTimeout")


def tally(stream: DataFrame, stamp: str, width: str, late: str, by: list[str]) -> DataFrame:
    """(start, by, n) in tumbling windows; rows later than `late` are dropped."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def folded_notices(rows: DataFrame, by: list[str], line: str, order: list[str], shown: int = 10) -> DataFrame:
    """(by, lines, more): the first lines of each notice and how many are not shown. A group's rows are cut to those shown by
    rank before they are gathered."""
    ranked = rows.withColumns({"_n": F.row_number().over(Window.partitionBy(*by).orderBy(*order)), "_all": F.count("*").over(Window.partitionBy(*by))})
    held = ranked.filter(F.col("_n") <= shown).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", line))).alias("l"), F.max("_all").alias("_all"))
    return held.select(*by, F.array_join(F.transform("l", lambda x: x[line]), "; ").alias("lines"), (F.col("_all") - F.size("l")).cast("bigint").alias("more"))


def drained(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What the stream gives once all that is there has been read; batches land in versioned folders of a shared folder."""
    folder = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        target = f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
