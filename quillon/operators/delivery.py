"""Rows on their way out: due notices, outboxes, mirrors with a mark, verdicts of a delivery, tables of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due_changes(changes: DataFrame, picks: DataFrame, schedule: DataFrame, id_: str, run: str, picked_at: str) -> DataFrame:
    """Changes of scheduled rows for everyone who picked them before the run: equalities, with the order in time on top."""
    return changes.join(schedule.select(id_), id_, "left_semi").join(picks, id_).filter(F.col(picked_at) < F.col(run))


def with_endpoints(rows: DataFrame, endpoints: DataFrame, user: str, endpoint: str) -> DataFrame:
    """The rows of users who have an endpoint, with all of theirs as one JSON array, in order."""
    each = endpoints.groupBy(user).agg(F.to_json(F.array_sort(F.collect_set(endpoint))).alias("endpoints"))  # a user's devices
    return rows.join(each, user)


def verdicts(answers: DataFrame, status: str, tries: str, most: int = 3) -> DataFrame:
    """Answers with `verdict`: ack where it was taken, prune where the endpoint is gone, hold where it may be tried again,
    release where it may not."""
    s = F.col(status)
    verdict = F.when(s.between(200, 299), "ack").when(s.isin(404, 410), "prune").when((s.isNull() | (s == 429) | (s >= 500)) & (F.col(tries) < most), "hold").otherwise("release")
    return answers.withColumn("verdict", verdict)


def pending(outbox: DataFrame, table: str, key: list[str], at: str, size: int) -> DataFrame:
    """The last operation of each key, with its batch of `size` in its table, in order of time."""
    last = Window.partitionBy(table, *key).orderBy(F.desc(at))
    order = Window.partitionBy(table).orderBy(at, *key)
    kept = outbox.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return kept.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("bigint")).drop("_n")


def drained_all(outbox: DataFrame, sent: DataFrame, table: str, key: list[str], at: str) -> DataFrame:
    """What is left of an outbox: operations that were not sent, or that came after the one that was."""
    done = sent.select(table, *key, F.col(at).alias("_sent"))
    return outbox.join(done, [table, *key], "left").filter(F.col("_sent").isNull() | (F.col(at) > F.col("_sent"))).drop("_sent")


def affected(before: DataFrame, after: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """(asked, there, gone): keys that a batch named, those that the target holds after it, and those that it held before and
    no longer does: what an upsert or a delete is verified by."""
    k = asked.select(*key).distinct()
    here = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    both = k.join(here(before, "_b"), key, "left").join(here(after, "_a"), key, "left")
    return both.agg(F.count("*").alias("asked"), F.count("_a").alias("there"), F.count_if(F.col("_b") & F.col("_a").isNull()).alias("gone"))


def advanced(rows: DataFrame, mark: DataFrame, at: str) -> DataFrame:
    """(mark, new_mark, n, refused): what a mirror would write: rows behind the mark, and the mark that goes last. A listing
    whose latest row is older than the mark is refused as a whole."""
    last = rows.agg(F.max(at).alias("_last"))
    held = mark.select(F.col(at).alias("mark")).crossJoin(F.broadcast(last))  # one row each
    n = rows.join(F.broadcast(mark.select(F.col(at).alias("_m"))), F.col(at) > F.col("_m")).agg(F.count("*").alias("n"))  # one mark
    refused = F.coalesce(F.col("_last") < F.col("mark"), F.lit(False))
    return held.crossJoin(n).select("mark", F.when(refused, F.col("mark")).otherwise(F.coalesce("_last", "mark")).alias("new_mark"), F.when(refused, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("n"), refused.alias("refused"))


def kept_since(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """The rows that retention leaves."""
    return rows.filter(F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS"))


def redrawn(ticks: DataFrame, by: list[str], at: str, *state: str) -> DataFrame:
    """Ticks whose state differs from the tick before: those on which anything has to be drawn."""
    w = Window.partitionBy(*by).orderBy(at)
    seen = F.sha2(F.to_json(F.struct(*state), {"ignoreNullFields": "false"}), 256)
    marked = ticks.withColumn("_s", seen).withColumn("_before", F.lag("_s").over(w))
    return marked.filter(F.col("_before").isNull() | (F.col("_before") != F.col("_s"))).drop("_s", "_before")


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with `line`, a row of a Markdown table; nulls are empty, signs that end a cell are escaped."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|\\])", r"\\$1") for c in columns]
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def counters(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n): rows of every stage of a run."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, each)


def paged(rows: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """One page of the rows in order: sorted and cut by Spark's own limit and offset."""
    return rows.orderBy(*order).offset(page * size).limit(size)


def spread_sample(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Of each group n rows, evenly spread over its order: those with the places floor(i * size / n)."""
    w = Window.partitionBy(*by)
    placed = rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)) - 1, "_m": F.count("*").over(w)})
    i = F.ceil(F.col("_k") * n / F.col("_m"))
    return placed.filter((F.col("_m") <= n) | ((F.floor(i * F.col("_m") / n) == F.col("_k")) & (i < n))).drop("_k", "_m")
