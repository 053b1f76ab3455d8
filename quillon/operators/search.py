"""Full-text search over postings: BM25, all-words-then-any, fuzzy terms, suggestions, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_: str, terms: Column) -> DataFrame:
    """(doc, term, tf): built once and written partitioned by term where many queries follow."""
    return docs.select(F.col(id_).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_: str, terms: Column, query: list[str]) -> DataFrame:
    """(doc, n_terms, score) of documents with a query term. Only query terms are exploded: the filter runs before the shuffle."""
    wanted = sorted(set(query))
    sized = docs.select(F.col(id_).alias("doc"), F.size(terms).alias("len"), F.filter(terms, lambda t: t.isin(wanted)).alias("hits"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = sized.filter(F.size("hits") > 0).select("doc", "len", F.explode("hits").alias("term")).groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("doc").agg(F.count("*").alias("n_terms"), F.sum(weight).alias("score"))  # stats: one row


def all_or_any(scored: DataFrame, n_query: int, enough: int = 8) -> DataFrame:
    """Documents with all terms; where fewer than `enough` have them, those with any term too, marked loose."""
    full = scored.agg(F.count_if(F.col("n_terms") == n_query).alias("full_hits"))
    return scored.crossJoin(F.broadcast(full)).filter((F.col("n_terms") == n_query) | (F.col("full_hits") < enough)).withColumn("loose", F.col("n_terms") < n_query).drop("full_hits")  # one row


def shortened(word: Column, most: int) -> Column:
    """The word and all that is left of it after up to `most` deletions."""
    level = out = F.array(word)
    for _ in range(most):
        cut = F.transform(level, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
        level = F.array_distinct(F.flatten(cut))
        out = F.array_union(out, level)
    return out


def fuzzy_terms(vocabulary: DataFrame, query: list[str], share: float = 0.2, prefix: int = 4) -> DataFrame:
    """(query, term, how) for exact terms, continuations of words of `prefix` letters, and close spellings of longer words.

    Terms meet the query by equal keys: their beginnings of the query words' lengths, and what deletions leave of them (two
    words within d edits share what some d deletions leave of each). Only terms of fitting length get the keys of d.
    """
    words = sorted(set(query))
    edits = {q: int(len(q) * share) if len(q) > 4 else 0 for q in words}
    spark = vocabulary.sparkSession
    lengths = sorted({len(q) for q in words})
    asked = spark.createDataFrame([(q, edits[q]) for q in words], "query string, edits int")
    starts = vocabulary.select("term", F.explode(F.array_distinct(F.array(*[F.substring("term", 1, n) for n in lengths]))).alias("query")) if words else vocabulary.select("term", F.lit("").alias("query")).limit(0)
    met = starts.join(F.broadcast(asked), "query")  # the query's words
    # Deletions multiply with the edits, so words of fifteen letters and more meet the terms of fitting length one by one.
    far = asked.filter(F.col("edits") > 2)
    if any(e > 2 for e in edits.values()):
        met = met.unionByName(vocabulary.select("term").join(F.broadcast(far), F.abs(F.length("term") - F.length("query")) <= F.col("edits")).select("query", "term", "edits"))
    for d in sorted({e for e in edits.values() if 0 < e <= 2}):
        own = [len(q) for q in words if edits[q] == d]
        keys = vocabulary.filter(F.length("term").between(min(own) - d, max(own) + d)).select("term", F.explode(shortened(F.col("term"), d)).alias("key"))
        wanted = asked.filter(F.col("edits") == d).select("query", "edits", F.explode(shortened(F.col("query"), d)).alias("key"))
        met = met.unionByName(keys.join(F.broadcast(wanted), "key").select("query", "term", "edits"))
    how = F.when(F.col("term") == F.col("query"), "exact").when((F.length("query") >= prefix) & F.col("term").startswith(F.col("query")), "prefix").when((F.col("edits") > 0) & (F.levenshtein("term", "query") <= F.col("edits")), "close")
    return met.withColumn("how", how).filter("how IS NOT NULL").select("query", "term", "how").distinct()


def suggest(names: DataFrame, group: str, name: str, typed: str, n: int = 5) -> DataFrame:
    """Per group the n most frequent names that begin with what was typed and are not it."""
    counts = names.filter(F.lower(name).startswith(typed.lower()) & (F.lower(name) != typed.lower())).groupBy(group, name).agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), name))).filter(F.col("r") <= n).withColumn("r", F.col("r").cast("bigint"))


def facet_counts(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of all facets in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")) for f, v in facets.items()]))
    return df.select(pairs.alias("p")).filter("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def longest_prefix(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows with `key`, the longest key that the column begins with as whole words, and `rest`. keys: a driver-side list."""
    text = F.lower(F.col(column))
    key = F.lit(None).cast("string")
    for k in sorted(keys, key=lambda k: (len(k), k)):
        key = F.when((text == k.lower()) | text.startswith(k.lower() + " "), k).otherwise(key)
    return df.withColumn("key", key).withColumn("rest", F.when(F.col("key").isNotNull(), F.ltrim(F.expr(f"substring(`{column}`, length(key) + 1)"))).otherwise(F.col(column)))


def longest_key(df: DataFrame, column: str, keys: DataFrame, key: str, few: int = 200_000) -> DataFrame:
    """Rows with `key`, the longest key of a table that the column begins with as whole words, and `rest`.

    Each distinct text is cut after every word, as far as the longest key goes, and meets the keys by equality; keys are
    broadcast as long as there are few.
    """
    known = keys.select(F.col(key).alias("_key"), F.lower(key).alias("_low"), F.size(F.split(key, " ")).alias("_words")).distinct()
    size = known.agg(F.count("*"), F.max("_words")).first()
    texts = df.select(F.col(column).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    words = F.split(F.lower("_text"), " ")
    cut = texts.withColumn("_low", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(size[1] or 1))), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))))
    best = cut.join(F.broadcast(known) if size[0] <= few else known, "_low").groupBy("_text").agg(F.max_by("_key", F.struct(F.length("_key"), "_key")).alias("key"))
    rest = F.when(F.col("key").isNotNull(), F.ltrim(F.substring(F.col(column), F.length("key") + 1, F.length(column)))).otherwise(F.col(column))
    return df.join(best, F.col(column) == F.col("_text"), "left").select(*df.columns, "key", rest.alias("rest"))
