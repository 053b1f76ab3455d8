"""Search over several fields: boosts, synonyms, whole phrases, a second ranking, and what filters hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .search import B, K1


def field_postings(docs: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """(doc, field, term, tf, len): the inverted index of several fields. Written partitioned by term it serves all queries."""
    both = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), words(text).alias("terms")) for name, text in fields.items()]))
    rows = docs.select(F.col(id_).alias("doc"), both.alias("f")).select("doc", "f.field", F.size("f.terms").alias("len"), F.explode("f.terms").alias("term"))
    return rows.groupBy("doc", "field", "term", "len").agg(F.count("*").alias("tf"))


def boosted(index: DataFrame, query: list[str], boosts: dict[str, float], total: int | None = None) -> DataFrame:
    """(doc, term, score): BM25 of every field times its boost, summed over the fields. Only query terms leave the index; the
    fields' mean lengths and a term's documents are counted first, a row a field and a row a term."""
    sizes = index.select("doc", "field", "len").distinct().groupBy("field").agg(F.avg("len").alias("mean"))
    hits = index.filter(F.col("term").isin(sorted(set(query))))
    df = hits.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    n = F.lit(total) if total is not None else F.col("n")
    scored = hits.join(F.broadcast(sizes), "field").join(F.broadcast(df), "term")  # fields and query terms
    if total is None:
        scored = scored.crossJoin(F.broadcast(index.agg(F.count_distinct("doc").alias("n"))))  # one row
    boost = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(b))) for f, b in boosts.items()])
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return scored.groupBy("doc", "term").agg(F.sum(weight).alias("score"))


def reranked(scored: DataFrame, matches: DataFrame, n_query: int) -> DataFrame:
    """(doc, score, coverage, quality, rank_score): the score times (0.5 + coverage) times (1 + quality / 2). scored: (doc,
    score); matches: (doc, query, term): what a document's terms matched. A query word's quality is 1 where it is a term, else
    the largest share that word and term have of each other, one beginning the other."""
    short, long = F.least(F.length("query"), F.length("term")), F.greatest(F.length("query"), F.length("term"))
    share = F.when(F.col("query") == F.col("term"), 1.0).when(F.col("term").startswith(F.col("query")) | F.col("query").startswith(F.col("term")), short / long).otherwise(0.0)
    each = matches.groupBy("doc", "query").agg(F.max(share).alias("q"))
    total = each.groupBy("doc").agg((F.count("*") / n_query).alias("coverage"), (F.sum("q") / n_query).alias("quality"))
    return scored.join(total, "doc").withColumn("rank_score", F.col("score") * (0.5 + F.col("coverage")) * (1 + 0.5 * F.col("quality")))


def phrases_in(docs: DataFrame, id_: str, terms: Column, phrases: DataFrame, phrase: str, longest: int) -> DataFrame:
    """(doc, phrase): phrases of whole words that a text holds: its runs of up to `longest` words meet them by equality."""
    def of(n: int) -> Column:
        return F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    runs = F.flatten(F.array(*[of(n) for n in range(1, longest + 1)]))
    said = docs.select(F.col(id_).alias("doc"), terms.alias("_w")).select("doc", F.explode(F.array_distinct(runs)).alias(phrase))
    return said.join(phrases.select(phrase).distinct(), phrase).select("doc", phrase)


def synonym_terms(docs: DataFrame, id_: str, terms: Column, groups: DataFrame, longest: int) -> DataFrame:
    """(doc, term): the other phrases of every group of which a text holds one. groups: (grp, phrase)."""
    held = phrases_in(docs, id_, terms, groups, "phrase", longest).join(groups, "phrase").select("doc", "grp").distinct()
    return held.join(groups, "grp").select("doc", F.col("phrase").alias("term")).distinct()


def with_phrase(docs: DataFrame, terms: Column, phrase: str) -> DataFrame:
    """The documents that hold the words of a phrase one after another."""
    wanted = words(F.lit(phrase))
    return docs.filter(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(wanted, " "), F.lit(" "))))


def sections(rows: DataFrame, id_: str, start: str, end: str, loose: Column, now: Column) -> DataFrame:
    """(id, section, r): upcoming exact hits, then loose ones, then past ones (latest first), each in order of start."""
    past = F.col(end) <= now
    section = F.when(past, "past").when(loose, "loose").otherwise("upcoming")
    micros = F.unix_micros(F.col(start).cast("timestamp"))
    placed = rows.select(F.col(id_), section.alias("section"), F.when(past, -micros).otherwise(micros).alias("_at"))
    return placed.withColumn("r", F.row_number().over(Window.partitionBy("section").orderBy("_at", id_)).cast("bigint")).drop("_at")


def at_place(rows: DataFrame, place: str, wanted: list[str], composites: DataFrame) -> DataFrame:
    """The rows in one of the wanted rooms, or in a composite (composite, room) that holds one of them."""
    holding = composites.filter(F.col("room").isin(wanted)).select(F.col("composite").alias(place))
    rooms = holding.unionByName(rows.sparkSession.createDataFrame([(w,) for w in wanted], f"{place} string")).distinct()
    return rows.join(rooms, place, "left_semi")


def hidden(matches: DataFrame, shown: DataFrame, id_: str, group: str) -> DataFrame:
    """(group, n): matches that a filter keeps out of what is shown."""
    return matches.join(shown.select(id_), id_, "left_anti").groupBy(group).agg(F.count("*").alias("n"))


def how_matched(terms: DataFrame) -> DataFrame:
    """(query, exact, prefix): of matched terms (query, how), whether any is exact and whether any is a beginning."""
    return terms.groupBy("query").agg(F.bool_or(F.col("how") == "exact").alias("exact"), F.bool_or(F.col("how") == "prefix").alias("prefix"))


def prefix_pairs(names: DataFrame, name: str) -> DataFrame:
    """(short, long): names of which one is the whole-word beginning of the other; beginnings meet names by equality."""
    each = names.select(F.col(name).alias("long")).distinct().withColumn("_w", F.split("long", " "))
    starts = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda n: F.array_join(F.slice("_w", F.lit(1), n), " "))
    begun = each.filter(F.size("_w") > 1).select("long", F.explode(starts).alias("short"))
    return begun.join(each.select(F.col("long").alias("short")), "short").select("short", "long")
