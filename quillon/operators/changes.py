"""What changed between versions of a listing, and what must hold between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm

#: Tasks that the pairs of a title can be dealt to.
TITLE_PARTS = 8

def change_kinds(previous: DataFrame, current: DataFrame, key: str, fields: dict[str, str], sets: dict[str, str], removed: str, cancelled: str, was: str) -> DataFrame:
    """(id, kind) of every change, of twelve kinds: added, removed, restored, cancelled, uncancelled and merged, and those of
    `fields` (kind -> column) and `sets` (kind -> array column, compared as sets). Rows that are removed in both say nothing,
    nor do the fields of a row that came or went. was: the ids that a row took in since."""
    cols = [removed, cancelled, was, *fields.values(), *sets.values()]
    both = previous.select(F.col(key).alias("id"), F.struct(*cols).alias("o")).join(current.select(F.col(key).alias("id"), F.struct(*cols).alias("n")), "id", "full_outer")
    old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    here = F.col("n").isNotNull() & ~new(removed)
    there = F.col("o").isNotNull() & ~old(removed)
    plain = lambda a: F.array_sort(F.array_distinct(F.coalesce(a, F.array().cast("array<string>"))))
    stay = here & there
    told = {
        "added": here & F.col("o").isNull(), "removed": ~here & there, "restored": here & F.col("o").isNotNull() & old(removed),
        "cancelled": stay & new(cancelled) & ~old(cancelled), "uncancelled": stay & ~new(cancelled) & old(cancelled),
        "merged": here & (F.size(F.array_except(plain(new(was)), plain(old(was)))) > 0),
    } | {k: stay & ~old(c).eqNullSafe(new(c)) for k, c in fields.items()} | {k: stay & ~plain(old(c)).eqNullSafe(plain(new(c))) for k, c in sets.items()}
    kinds = F.filter(F.array(*[F.when(F.coalesce(is_, F.lit(False)), F.lit(k)) for k, is_ in told.items()]), lambda x: x.isNotNull())
    return both.select("id", F.explode(kinds).alias("kind"))


def vanished(previous: DataFrame, current: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """(id): ids that are in no row any more and were merged into none."""
    return previous.select(key).distinct().join(current.select(key), key, "left_anti").join(merged.select(key), key, "left_anti")


def changed_at(previous: DataFrame, current: DataFrame, key: str, digest: Column, stamp: str, now: Column) -> DataFrame:
    """Current rows with the stamp of the previous version where their digests agree, else now."""
    before = previous.select(key, digest.alias("_before"), F.col(stamp).alias("_at"))
    return current.withColumn("_digest", digest).join(before, key, "left").withColumn(stamp, F.when(F.col("_before") == F.col("_digest"), F.col("_at")).otherwise(now)).drop("_before", "_at", "_digest")


def loosely_matched(gone: DataFrame, new: DataFrame, id_: str, title: str, start: str, room: str) -> DataFrame:
    """(gone, new, differs): rows whose titles agree once normalised, and whether they moved in time, in place or in both.

    The pairs of a title grow with the square of its rows and are the result, so the work is dealt out by title and a hash of
    one side's id: the other side stands in every one of TITLE_PARTS parts, and a title with many rows is no single task.
    """
    tasks = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda df, s: df.select(F.col(id_).alias(s), norm(F.col(title)).alias("_t"), F.col(start).alias(f"_s{s}"), F.col(room).alias(f"_r{s}"))
    dealt = side(gone, "gone").withColumn("_part", F.pmod(F.xxhash64("gone"), F.lit(TITLE_PARTS))).repartition(tasks, "_t", "_part")
    both = dealt.join(side(new, "new").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TITLE_PARTS - 1).cast("long")))), ["_t", "_part"])
    later, elsewhere = ~F.col("_sgone").eqNullSafe(F.col("_snew")), ~F.col("_rgone").eqNullSafe(F.col("_rnew"))
    return both.select("gone", "new", F.when(later & elsewhere, "both").when(later, "start").when(elsewhere, "room").otherwise("none").alias("differs"))


def returns(versions: DataFrame, key: str, version: str) -> DataFrame:
    """(key, left_at, back_at): stretches of versions without the key between two that hold it."""
    w = Window.partitionBy(key).orderBy(version)
    after = versions.select(key, version).distinct().withColumn("back_at", F.lead(version).over(w))
    return after.filter(F.col("back_at") > F.col(version) + 1).select(key, (F.col(version) + 1).alias("left_at"), "back_at")


def returned_otherwise(versions: DataFrame, id_: str, key: str, version: str) -> DataFrame:
    """(key, left_at, back_at): content that was away for a version or more and came back under other ids only."""
    held = versions.groupBy(key, version).agg(F.array_sort(F.collect_set(id_)).alias("ids"))  # the ids of one content in one version
    w = Window.partitionBy(key).orderBy(version)
    pairs = held.withColumns({"back_at": F.lead(version).over(w), "then": F.lead("ids").over(w)})
    return pairs.filter((F.col("back_at") > F.col(version) + 1) & ~F.arrays_overlap("ids", "then")).select(key, (F.col(version) + 1).alias("left_at"), "back_at")


def last_with_repeats(versions: DataFrame, key: str, version: str) -> DataFrame:
    """(version, n): the last version in which a key is held more than once, and how many keys are."""
    twice = versions.groupBy(version, key).agg(F.count("*").alias("m")).filter("m > 1").groupBy(version).agg(F.count("*").alias("n"))
    return twice.agg(F.max_by(F.struct(version, "n"), version).alias("x")).select("x.*")


def turning_points(versions: DataFrame, source: str, id_: str, version: str) -> DataFrame:
    """(source, version, id, before): the versions in which a source's id is another than in the one before."""
    w = Window.partitionBy(source).orderBy(version)
    moved = versions.withColumns({"before": F.lag(id_).over(w), "_n": F.row_number().over(w)})
    return moved.filter((F.col("_n") == 1) | ~F.col("before").eqNullSafe(F.col(id_))).select(source, version, id_, "before")


def flagged(versions: DataFrame, commits: DataFrame, at: str, code: str) -> DataFrame:
    """Versions with `code_changed`: whether any commit of code came after the version before and up to this one. Each commit
    is put to the first version at or after it, by one sort of both."""
    a = versions.select(F.col(at).alias("_at"), F.lit(1).alias("_v"), F.lit(False).alias("_c"))
    b = commits.select(F.col(at).alias("_at"), F.lit(0).alias("_v"), F.col(code).alias("_c"))
    # Versions are few (one a run), and so is what stands between them.
    steps = a.unionByName(b).withColumn("_n", F.sum("_v").over(Window.orderBy("_at", "_v").rowsBetween(Window.unboundedPreceding, -1)))
    marks = steps.groupBy(F.coalesce("_n", F.lit(0)).alias("_n")).agg(F.bool_or("_c").alias("code_changed"), F.max(F.when(F.col("_v") == 1, F.col("_at"))).alias(at))
    return versions.join(marks.select(at, "code_changed"), at)


def fail_safe(changes: DataFrame, mark: Column, runs: DataFrame, run: str, flag: str) -> DataFrame:
    """Changes of runs after the mark; where nothing is known of a run, its flag is set."""
    return changes.filter(F.col(run) > mark).join(runs.select(run, flag), run, "left").withColumn(flag, F.coalesce(flag, F.lit(True)))


def phases(changes: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """(phase, kind, n) before, during and after a span of days."""
    day = F.to_date(at)
    phase = F.when(day < F.lit(first).cast("date"), "before").when(day > F.lit(last).cast("date"), "after").otherwise("during")
    return changes.groupBy(phase.alias("phase"), "kind").agg(F.count("*").alias("n"))


def to_delete(table: DataFrame, file: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """(key, stray): rows of a mirror that its file lacks; stray where no merge explains them."""
    gone = table.select(key).join(file.select(key), key, "left_anti")
    known = merged.select(key, F.lit(False).alias("_known")).distinct()
    return gone.join(known, key, "left").select(key, F.col("_known").isNull().alias("stray"))


def appended(log: DataFrame, longer: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(order, problem): lines of a log that its longer version lost, changed, or put before its end. Empty for one that was
    only appended to."""
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    end = log.agg(F.max(order).alias("_end"))
    both = log.select(order, line.alias("_a")).join(longer.select(order, line.alias("_b")), order, "full_outer").crossJoin(F.broadcast(end))  # one row
    problem = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull() & (F.col(order) <= F.col("_end")), "put in").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(order, problem.alias("problem")).filter("problem IS NOT NULL")


def worth_writing(previous: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(n, differ, write): rows of both, those that differ in the columns (the stamp is not one of them), and whether the
    current version is worth writing."""
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    both = previous.select(key, line.alias("_a")).join(current.select(key, line.alias("_b")), key, "full_outer")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differ")).withColumn("write", F.col("differ") > 0)
