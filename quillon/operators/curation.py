"""Registries kept by hand: status lookups, rows to add, link classes, where rows went, which run made a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import ends, settled


def first_source(df: DataFrame, key: str, sources: dict[str, DataFrame], otherwise: str) -> DataFrame:
    """Adds `status`: the name of the first source that holds the key."""
    status = F.lit(otherwise)
    for name, source in reversed(sources.items()):
        held = source.select(key).distinct().withColumn(f"_in_{name}", F.lit(True))
        df = df.join(held, key, "left")
        status = F.when(F.col(f"_in_{name}"), name).otherwise(status)
    return df.withColumn("status", status).drop(*[f"_in_{n}" for n in sources])


def mint_plan(names: DataFrame, known: DataFrame, name: str, key: Column) -> DataFrame:
    """(key, spelling, n, spellings, tied): rows to add for names whose key is not known; the commonest spelling is taken,
    then the shortest, then the first. Counts of spellings are made before keys are gathered."""
    counts = names.filter(F.col(name).isNotNull()).groupBy(key.alias("key"), F.col(name).alias("spelling")).agg(F.count("*").alias("n"))
    open_ = counts.join(known.select("key").distinct(), "key", "left_anti")
    best = F.min_by("spelling", F.struct(-F.col("n"), F.length("spelling"), "spelling"))
    top = open_.groupBy("key").agg(best.alias("spelling"), F.sum("n").alias("n"), F.count("*").alias("spellings"), F.max("n").alias("_max"))
    ties = open_.groupBy("key", "n").agg(F.count("*").alias("_t")).withColumnRenamed("n", "_max")
    return top.join(ties, ["key", "_max"]).select("key", "spelling", "n", "spellings", (F.col("_t") > 1).alias("tied"))


def link_class(pairs: DataFrame, closure: DataFrame, old: str, new: str) -> DataFrame:
    """Adds `moved`: same, lost, gained, narrower (the new one lies under the old), wider, other. closure: (id, ancestor)."""
    up = closure.select("id", "ancestor").distinct()
    narrower = up.select(F.col("id").alias(new), F.col("ancestor").alias(old)).withColumn("_narrow", F.lit(True))
    wider = up.select(F.col("id").alias(old), F.col("ancestor").alias(new)).withColumn("_wide", F.lit(True))
    both = pairs.join(narrower, [old, new], "left").join(wider, [old, new], "left")
    moved = F.when(F.col(old).eqNullSafe(F.col(new)), "same").when(F.col(new).isNull(), "lost").when(F.col(old).isNull(), "gained").when(F.col("_narrow"), "narrower").when(F.col("_wide"), "wider").otherwise("other")
    return both.withColumn("moved", moved).select(*pairs.columns, "moved")


def where_removed_went(previous: DataFrame, current: DataFrame, id_: str, key: str) -> DataFrame:
    """(id, went): removed rows whose content is `added` under a new id, `kept` under an old one, or `gone`."""
    ids = previous.select(id_).distinct().withColumn("_old", F.lit(1))
    bins = current.join(ids, id_, "left").groupBy(key).agg(F.max(F.when(F.col("_old").isNull(), 1).otherwise(0)).alias("_added"))
    gone = previous.join(current.select(id_), id_, "left_anti").join(bins, key, "left")
    return gone.select(id_, F.when(F.col("_added") == 1, "added").when(F.col("_added") == 0, "kept").otherwise("gone").alias("went"))


def reordered(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Adds `change`: same, order (equal as multisets) or values."""
    a, b = F.col(old), F.col(new)
    return pairs.withColumn("change", F.when(a.eqNullSafe(b), "same").when(F.array_sort(a).eqNullSafe(F.array_sort(b)), "order").otherwise("values"))


def made_by(points: DataFrame, runs: DataFrame, id_: str, at: str, start: str, end: str, run: str, good: str, slot: str = "DAY") -> DataFrame:
    """Points with the run whose interval holds them: of several the one that succeeded, where only one did; else null.

    Runs are dealt to the slots of time they touch, so the join is by equality.
    """
    step = F.expr(f"INTERVAL 1 {slot}")
    dealt = runs.select(F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(run).alias("_run"), F.col(good).alias("_good"))
    dealt = dealt.filter("_e >= _s").withColumn("_slot", F.explode(F.sequence(F.date_trunc(slot, "_s"), F.date_trunc(slot, "_e"), step)))
    placed = points.select(id_, F.col(at).alias("_at"), F.date_trunc(slot, F.col(at)).alias("_slot"))
    found = placed.join(dealt, (placed["_slot"] == dealt["_slot"]) & (F.col("_at") >= F.col("_s")) & (F.col("_at") <= F.col("_e")))
    best = found.groupBy(id_).agg(F.count("*").alias("n"), F.count_if("_good").alias("good"), F.min("_run").alias("one"), F.min(F.when(F.col("_good"), F.col("_run"))).alias("chosen"))
    return points.join(best.select(id_, F.when(F.col("good") == 1, F.col("chosen")).when(F.col("n") == 1, F.col("one")).alias("run")), id_, "left")


def heads(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `head`: whether the value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn("head", first | ~before.eqNullSafe(F.col(value)))


def fitting(df: DataFrame, by: list[str], order: list[str], line: str, cap: int) -> DataFrame:
    """The lines of each group that fit in `cap` characters, a line feed between them, without leaving one out before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_upto", F.sum(F.length(line) + 1).over(w) - 1).filter(F.col("_upto") <= cap).drop("_upto")


def cycles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node): nodes of a forest that lie on a ring, by doubling the jumps until no chain of any length is left; a node's
    parent is unique."""
    links = settled(edges.filter(F.col(parent).isNotNull()).select(F.col(child).alias("id"), F.col(parent).alias("to")).distinct())
    _, ring = ends(links)
    none = links.select(F.col("id").alias("node")).filter("false")
    if ring is None:
        return none
    # What is jumped to after more jumps than there are links lies on a ring; all of a ring is jumped to.
    return ring.select(F.col("id").alias("node"))
