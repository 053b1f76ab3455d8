"""Registries of tracks, people and works: names resolved to entries, facts merged from several entries, forests of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curation import cycles
from .hierarchy import closure


def entry_keys(registry: DataFrame, id_: str, name: str, aliases: str, key) -> DataFrame:
    """(key, id) of every name and alias of a registry; where entries share one, the first id has it."""
    names = F.explode(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))
    return registry.select(F.col(id_).alias("id"), names.alias("_n")).groupBy(key(F.col("_n")).alias("key")).agg(F.min("id").alias("id"))


def resolved_names(rows: DataFrame, item: str, names: str, keys: DataFrame, key) -> DataFrame:
    """(item, position, said, id): each name of a list in order with the entry it means, null for none."""
    said = rows.select(item, F.posexplode(names).alias("position", "said"))
    return said.withColumn("key", key(F.col("said"))).join(keys, "key", "left").select(item, "position", "said", "id")


def with_entries(rows: DataFrame, item: str, names: str, keys: DataFrame, key, otherwise) -> DataFrame:
    """(item, ids): the entries of a list in its order, each once, with a made-up id for names without one."""
    found = resolved_names(rows, item, names, keys, key).withColumn("id", F.coalesce("id", otherwise(F.col("said"))))
    first = found.groupBy(item, "id").agg(F.min("position").alias("p"))  # before lists are gathered
    return first.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda x: x["id"]).alias("ids"))


def misses(found: DataFrame) -> DataFrame:
    """(said, n): names without an entry, and how often each was said."""
    return found.filter("id IS NULL").groupBy("said").agg(F.count("*").alias("n"))


def classified(answers: DataFrame, works: DataFrame, terms: DataFrame, item: str, name: str, key) -> DataFrame:
    """(item, name, work, fate): what a named work is: `work` of the registry by name or alias, a `term` that means no work,
    or `unresolved`."""
    asked = answers.withColumn("key", key(F.col(name)))
    both = asked.join(works.select("key", F.col("id").alias("work")), "key", "left").join(terms.select("key").distinct().withColumn("_t", F.lit(True)), "key", "left")
    fate = F.when(F.col("work").isNotNull(), "work").when(F.col("_t"), "term").otherwise("unresolved")
    return both.select(item, name, "work", fate.alias("fate"))


def best_links(links: DataFrame, item: str, node: str, via: str, order: tuple[str, ...] = ("about", "track", "credit")) -> DataFrame:
    """One link of an item and a node: the strongest way, by the order given."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(via))
    return links.groupBy(item, node).agg(F.min_by(via, F.struct(rank, via)).alias(via))


def linked_below(links: DataFrame, forest: DataFrame, item: str, node: str, wanted: str, ways: list[str]) -> DataFrame:
    """(item): items linked, in one of the ways, to a node or to one below it."""
    below = closure(forest).filter(F.col("ancestor") == wanted).select(F.col("id").alias(node))
    return links.filter(F.col("via").isin(ways)).join(below, node, "left_semi").select(item).distinct()


def cast_only(links: DataFrame, item: str, node: str, wanted: str) -> DataFrame:
    """(item): items that a credit links to a node and that are not about it."""
    own = links.filter(F.col(node) == wanted)
    return own.filter("via = 'credit'").select(item).distinct().join(own.filter("via = 'about'").select(item), item, "left_anti")


def block(links: DataFrame, forest: DataFrame, node: str) -> DataFrame:
    """(id, parent): the entries that links name, and all above them."""
    above = links.select(F.col(node).alias("id")).distinct().join(closure(forest), "id").select(F.col("ancestor").alias("id")).distinct()
    return above.join(forest.select("id", "parent"), "id", "left")


def outline(forest: DataFrame, name: str) -> DataFrame:
    """(id, depth, r): the nodes in pre-order, names in order at every level, each with its depth.

    A node's path is the names from its root down; paths come from the closure, and one sort of them is the outline. Nodes
    on a ring have no root and no place.
    """
    up = closure(forest).join(forest.select(F.col("id").alias("ancestor"), F.struct(F.col(name), F.col("id")).alias("_n"), F.col("parent").isNull().alias("_root")), "ancestor")
    paths = up.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "_n"))), lambda x: x["_n"]).alias("path"), F.max("depth").cast("int").alias("depth"), F.bool_or("_root").alias("_root"))
    ordered = Window.orderBy("path")  # nodes of a registry
    return paths.filter("_root").select("id", "depth", F.row_number().over(ordered).cast("bigint").alias("r"))


def acyclic(links: DataFrame, child: str, parent: str) -> DataFrame:
    """The links without those that close a ring: of every ring the link of its largest child goes, as if links had been
    admitted in the order of their children. A node's parent is unique, so rings do not touch."""
    on = cycles(links, child, parent).withColumnRenamed("node", child)
    ring = links.join(on, child, "left_semi").select(F.col(child).alias("id"), F.col(parent).alias("parent"))
    # All nodes of a ring reach one another; a node that reaches none larger than itself is its ring's largest.
    last = closure(ring).groupBy("id").agg(F.max("ancestor").alias("most")).filter("most <= id").select(F.col("id").alias(child))
    return links.join(last, child, "left_anti")


def merged_axes(tracks: Column, own: Column, cap: int = 2) -> Column:
    """The values that deciding tracks give an axis, in order and each once, at most `cap`; the answer's own where they give none."""
    given = F.slice(F.array_distinct(F.flatten(F.filter(tracks, lambda t: t.isNotNull()))), 1, cap)
    return F.when(F.size(given) > 0, given).otherwise(F.slice(F.coalesce(own, F.array().cast("array<string>")), 1, cap))


def strongest(values: Column, order: tuple[str, ...]) -> Column:
    """The first value of the order that a list holds; null for none."""
    return F.coalesce(*[F.when(F.array_contains(values, v), v) for v in order])


def candidates(credits: DataFrame, person: str, role: str, title: str, at: str) -> DataFrame:
    """(person, roles, titles): per person how often each role is named, and the distinct titles in the order first seen."""
    n = credits.groupBy(person, role).agg(F.count("*").alias("n")).groupBy(person).agg(F.array_sort(F.collect_list(F.struct(role, "n"))).alias("roles"))
    seen = credits.groupBy(person, title).agg(F.min(at).alias("_a")).groupBy(person).agg(F.transform(F.array_sort(F.collect_list(F.struct("_a", title))), lambda x: x[title]).alias("titles"))
    return n.join(seen, person)


def got_or_created(names: DataFrame, known: DataFrame, key) -> DataFrame:
    """(key, id, created): the entry of every name, and a new one, named by its key, for those without."""
    keys = names.select(key.alias("key")).distinct().join(known.select("key", "id"), "key", "left")
    return keys.select("key", F.coalesce("id", F.concat(F.lit("new-"), "key")).alias("id"), F.col("id").isNull().alias("created"))


def left_unsaid(rows: DataFrame, item: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(rule, n): rows whose wording says a thing that their facet leaves unset. rules: name -> (said, facet)."""
    told = F.filter(F.array(*[F.when(said & facet.isNull(), F.lit(name)) for name, (said, facet) in rules.items()]), lambda x: x.isNotNull())
    return rows.select(item, F.explode(told).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def disagreeing(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """(one, other, n): pairs of values that two readings of the same thing give, where they differ."""
    both = a.select(*on, F.col(value).alias("one")).join(b.select(*on, F.col(value).alias("other")), on)
    return both.filter(~F.col("one").eqNullSafe(F.col("other"))).groupBy("one", "other").agg(F.count("*").alias("n"))
