"""Labels from an outside model: only inputs that the cache lacks are asked for, in batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 25  # inputs a request holds


def input_key(*columns: str) -> Column:
    """Hash of an input; null and empty are the same."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def misses(inputs: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    """(key, columns, n): distinct inputs without a cached answer, and how many rows share each."""
    asked = inputs.groupBy(input_key(*columns).alias("key"), *columns).agg(F.count("*").alias("n"))
    return asked.join(cache.select("key"), "key", "left_anti")


def ask(wanted: DataFrame, columns: list[str], labeller: Callable[[list[dict]], list[str | None]], retries: int = 1) -> DataFrame:
    """(key, answer, failed): one request for each BATCH rows of a partition; a request that raises, or gives another number
    of answers, is tried again, then its rows are marked failed and stay out of the cache."""

    def request(rows: list[dict]) -> list[str | None] | None:
        for _ in range(retries + 1):
            try:
                said = labeller(rows)
            except Exception:  # noqa: BLE001 the labeller is the caller's: any fault of it fails the request, not the job
                continue
            if len(said) == len(rows):
                return said
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.iloc[k : k + BATCH]
                said = request(part[columns].to_dict("records"))
                yield pd.DataFrame({"key": part["key"], "answer": said or [None] * len(part), "failed": said is None})

    return wanted.select("key", *columns).mapInPandas(run, "key string, answer string, failed boolean")
