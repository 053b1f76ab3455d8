"""Language-model scores by prediction by partial matching over a byte-context trie.

Counting covers all training texts: each task counts strings of ORDER + 1 symbols (bytes, A-Z lower-cased, and an end of
text) and words, buckets add the counts up, and shorter contexts are sums of longer ones. A symbol's probability starts at
the longest known context; where it is not seen there, the escape is paid (method C: as many escapes as distinct symbols)
and the next shorter context answers with the symbols of the longer one excluded; after order 0 come all other symbols
alike. The code length of a text is the sum over its symbols.

Nothing is cut from the model. A symbol's probability is a function of its string of ORDER + 1 symbols. For the most
frequent strings (at most NODES) it is broadcast; all others are looked up by an exchange: strings and lookups go to
buckets by their last NEAR context bytes, so that a bucket holds every longer context of its lookups. The nodes of contexts
under NEAR bytes, whose number the alphabet bounds, are broadcast.

Beside it, the unigram base: add-one word probabilities; the HEAD most frequent words are broadcast, rarer words are joined.

Defined cases: null text: empty (the end symbol alone); a null doc_id is scored and not learned from; repeated rows count
and are scored each; no training text: every symbol has probability 1/257; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import _LOWER, blocks, distinct_counts, gather, mix64, scatter, text_arrays, tidied, tidy, total_bytes, word_bounds, word_hashes, written

ORDER, END = 5, 256
#: Context bytes that name a bucket.
NEAR = 3
#: Bounds of what is broadcast: strings and words.
NODES, HEAD = 1 << 20, 1 << 20
#: Symbols counted before a task sends its sums; buckets, at least, and text bytes that a bucket stands for beyond that.
CHUNK, BUCKETS, BUCKET_BYTES = 6 << 20, 64, 16 << 20
_TAG = 52  # the order stands above the 49 bits of context and symbol


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol) of every byte and end of the texts, and where each text's begin. A context holds the ORDER bytes
    before, nearest in the lowest bits; texts begin after line feeds."""
    docs, pad = len(offs) - 1, ORDER
    first = offs[:-1] + np.arange(docs) * (pad + 1)  # of each text's padding
    stream = np.full(len(data) + docs * (pad + 1), 10, np.uint16)
    real = np.ones(len(stream), bool)
    for k in range(pad):
        real[first + k] = False
    ends = first + pad + np.diff(offs)
    stream[ends] = END
    body = real.copy()
    body[ends] = False
    stream[body] = _LOWER[data]
    context = np.zeros(len(stream), np.uint64)
    low = (stream & np.uint16(0xFF)).astype(np.uint64)
    for k in range(1, pad + 1):
        context[k:] |= low[:-k] << np.uint64(8 * (k - 1))
    return context[real], stream[real].astype(np.uint64), offs[:-1] + np.arange(docs)


def place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each string."""
    return (mix64((keys >> np.uint64(9)) & np.uint64((1 << (8 * NEAR)) - 1)) % np.uint64(buckets)).astype(np.int64)


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = runs(keys)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def level(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of order k that strings add up to: order, key, count, and of its context the total and the distinct symbols."""
    keys, n = summed(keys & np.uint64((1 << (8 * k + 9)) - 1), n)
    first = runs(keys >> np.uint64(9))
    symbols_of = np.diff(np.append(first, len(keys)))
    total = np.add.reduceat(n, first) if len(first) else n
    return np.full(len(keys), k), keys, n, np.repeat(total, symbols_of), np.repeat(symbols_of, symbols_of)


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, key, n, seen) over all texts: kind 0 strings of ORDER + 1 symbols, with log10 of the last one's
    probability after the others; kind 1 words by hash."""

    def run(batches):
        found, words = np.empty(0, np.uint64), []
        held = 0

        def flush():
            rows = []
            strings = found[:held]
            strings.sort()
            first = runs(strings)
            keys, n = strings[first], np.diff(np.append(first, held))
            rows += [(0, *r) for r in scatter(place(keys, buckets), keys, n.astype("<i8"))]
            keys, n = distinct_counts(np.concatenate(words))
            rows += [(1, *r) for r in scatter((mix64(keys) % np.uint64(buckets)).astype(np.int64), keys, n.astype("<i8"))]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "key", "n"])

        for batch in batches:
            data, offs = text_arrays(batch.column("text"))
            for i, j in blocks(offs):
                part, edges = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                context, symbol, _ = symbols(part, edges)
                if held and held + len(symbol) > CHUNK:
                    yield flush()
                    words, held = [], 0
                if held + len(symbol) > len(found):  # one buffer, sorted where it is
                    grown = np.empty(max(held + len(symbol), min(CHUNK, 2 * len(found))), np.uint64)
                    grown[:held] = found[:held]
                    found = grown
                found[held : held + len(symbol)] = (context << np.uint64(9)) | symbol
                starts, ends, _ = word_bounds(part, edges)
                words.append(word_hashes(part, starts, ends))
                held += len(symbol)
        if held:
            yield flush()

    def add(key, table):
        keys, n = gather(table.column("key"), np.uint64), gather(table.column("n"), "<i8")
        kind, bucket = (k.as_py() for k in key)
        if kind:
            keys, n = summed(keys, n)
            seen = np.zeros(len(keys))
        else:
            _, keys, n, total, symbols_of = level(keys, n, ORDER)
            seen = np.log10(n) - np.log10(total + symbols_of)
        return pa.table({"kind": pa.array(np.full(len(keys), kind), pa.int32()), "bucket": pa.array(np.full(len(keys), bucket), pa.int32()), "key": keys.view(np.int64), "n": n, "seen": seen})

    rows = docs.mapInArrow(tidy(run), "kind int, bucket int, key binary, n binary")
    return rows.groupBy("kind", "bucket").applyInArrow(lambda key, table: tidied(add, key, table), "kind int, bucket int, key bigint, n bigint, seen double")


def floor_for(counts: DataFrame, most: int) -> int:
    """The smallest count c such that at most `most` rows have n >= c, up to the steps of a fixed scale."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16) - 32).cast("int")
    total, found = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect(), key=lambda r: -r["level"]):  # a few hundred levels
        total += r["m"]
        if total > most:
            break
        found = r["least"]
    return found if found is not None else 1 << 62


class HashTable:
    """Places of 64-bit keys, looked up all at once. Only the keys are sent; each worker builds its table."""

    def __getstate__(self) -> np.ndarray:
        return self.source

    def __setstate__(self, keys: np.ndarray) -> None:
        self.__init__(keys)

    def __init__(self, keys: np.ndarray):
        self.source = keys
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            self.probes += 1
            here = slot[left]
            free = left[self.at[here] < 0]
            self.at[slot[free]] = free
            self.keys[slot[free]] = keys[free]
            left = left[self.at[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            s = slot[open_]
            hit = self.keys[s] == keys[open_]
            out[open_[hit]] = self.at[s[hit]]
            open_ = open_[~hit & (self.at[s] >= 0)]
        return out


class Trie:
    """Code lengths from nodes: (order, context and symbol, count, total of the context)."""

    def __init__(self, order: np.ndarray, key: np.ndarray, n: np.ndarray, total: np.ndarray):
        key = key.view(np.uint64)
        tag = order.astype(np.uint64) << np.uint64(_TAG)
        self.grams = HashTable(tag | key)
        spot = tag | (key >> np.uint64(9))
        by = np.argsort(spot)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), bool), spot[by][1:] != spot[by][:-1]]))
        contexts = spot[by][first]
        self.contexts = HashTable(contexts)
        own = np.empty(len(by), np.int64)
        own[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
        count = np.bincount(own, minlength=len(first)).astype(float)
        kept = np.bincount(own, n, len(first))
        whole = total[by][first].astype(float)
        level = (contexts >> np.uint64(_TAG)).astype(np.int64)
        # The next shorter context, and what of it is excluded after an escape from here.
        shorter = (contexts & ((np.uint64(1) << (np.uint64(8) * np.maximum(level - 1, 0).astype(np.uint64))) - np.uint64(1))) | (np.maximum(level - 1, 0).astype(np.uint64) << np.uint64(_TAG))
        up = np.where(level > 0, self.contexts.find(shorter), -1)
        mask = (np.uint64(1) << (np.uint64(8) * np.maximum(order - 1, 0).astype(np.uint64) + np.uint64(9))) - np.uint64(1)
        parent = self.grams.find((key & mask) | (np.maximum(order - 1, 0).astype(np.uint64) << np.uint64(_TAG)))
        excluded = np.bincount(own, np.where((order > 0) & (parent >= 0), n[parent], 0), len(first))
        have = up >= 0
        rest_n = np.where(have, whole[up] - excluded, 0)
        rest_kept = np.where(have, kept[up] - excluded, 0)
        rest_count = np.where(have, count[up] - count, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.log10((whole - kept + count) / (whole + count))
            self.below = np.where(rest_count > 0, np.log10(rest_n + rest_count), 0.0)
            self.escape_below = np.where(rest_count > 0, np.log10((rest_n - rest_kept + rest_count) / (rest_n + rest_count)), 0.0)
        self.log_n = np.log10(n)
        self.seen = self.log_n - np.log10(whole + count)[own]
        root = np.flatnonzero(level == 0)
        self.last = -math.log10(max(1, 257 - int(count[root[0]]))) if len(root) else -math.log10(257)

    def score(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after its context."""
        out = np.zeros(len(context))
        live, before = np.arange(len(context)), np.full(len(context), -1, np.int64)
        for k in range(ORDER, -1, -1):
            tag = np.uint64(k << _TAG)
            here = context[live] & np.uint64((1 << (8 * k)) - 1)
            at = self.grams.find((here << np.uint64(9)) | symbol[live] | tag)
            hit = at >= 0
            done, at = live[hit], at[hit]
            b = before[hit]
            out[done] += np.where(b < 0, self.seen[at], self.log_n[at] - self.below[b])
            live, before, here = live[~hit], before[~hit], here[~hit]
            if not len(live):
                return out
            spot = self.contexts.find(here | tag)
            out[live] += np.where(before >= 0, self.escape_below[before], np.where(spot >= 0, self.escape[spot], 0.0))
            before = np.where((spot >= 0) | (before < 0), spot, before)
        out[live] += self.last
        return out


def held_out(doc_id: str, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(texts: DataFrame, name: str = "ppm") -> tuple[DataFrame, DataFrame, int]:
    """The tables of strings (bucket, key, n, seen) and of words (key, n), from all rows of (text), and the buckets."""
    buckets = max(BUCKETS, total_bytes(texts, "text") // BUCKET_BYTES)
    counts = written(counted(texts.select("text"), buckets), f"{name}-counts")
    return counts.filter("kind = 0").select("bucket", "key", "n", "seen"), counts.filter("kind = 1").select("key", "n"), buckets


def looked_up(lookups: DataFrame, strings: DataFrame, buckets: int) -> DataFrame:
    """(row, far): the sum of log10 of the probabilities of each row's strings in `far`, from all nodes."""
    mask = (1 << (8 * (NEAR - 1) + 9)) - 1
    near = strings.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    near = np.asarray(near.column("key")).view(np.uint64), np.asarray(near.column("n"))
    shared = lookups.sparkSession.sparkContext.broadcast([level(*near, k)[:4] for k in range(NEAR)])

    def spread(batches):
        for batch in batches:
            lists = batch.column("far")
            rows = np.repeat(np.asarray(batch.column("row")), np.diff(np.asarray(lists.offsets)))
            keys = np.asarray(lists.flatten()).view(np.uint64)
            edges = [*runs(rows >> 40).tolist(), len(keys)]  # of the partitions that the rows were numbered in
            for i, j in ((i, min(i + CHUNK // 8, b)) for a, b in zip(edges, edges[1:]) for i in range(a, b, CHUNK // 8)):
                found = list(scatter(place(keys[i:j], buckets), keys[i:j], (rows[i:j] - rows[i]).astype("<u4")))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([int(rows[i])] * len(found), pa.int64()), *(pa.array([f[c] for f in found], pa.binary()) for c in (1, 2))], names=["bucket", "base", "key", "row"])

    def answer(strings, lookups):
        if not lookups.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
        keys, n = np.asarray(strings.column("key")).view(np.uint64), np.asarray(strings.column("n"))
        nodes = [np.concatenate(c) for c in zip(*shared.value, *(level(keys, n, k)[:4] for k in range(NEAR, ORDER + 1)), strict=True)]
        trie = Trie(*nodes) if len(nodes[0]) else None
        wanted = gather(lookups.column("key"), np.uint64)
        each = np.fromiter((len(x.as_buffer()) // 4 for x in lookups.column("row")), np.int64, lookups.num_rows)
        rows = np.repeat(np.asarray(lookups.column("base")), each) + gather(lookups.column("row"), "<u4")
        found = np.full(len(wanted), -math.log10(257))
        if trie is not None:
            for i in range(0, len(wanted), 1 << 19):
                part = wanted[i : i + (1 << 19)]
                found[i : i + len(part)] = trie.score(part >> np.uint64(9), part & np.uint64(511))
        rows, found = summed(rows, found)
        return pa.table({"row": rows, "far": found})

    sent = lookups.mapInArrow(tidy(spread), "bucket int, base bigint, key binary, row binary")
    answers = strings.select("bucket", "key", "n").groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(lambda strings, lookups: tidied(answer, strings, lookups), "row bigint, far double")
    return answers.groupBy("row").agg(F.sum("far").alias("far"))


def scored(docs: DataFrame, strings: DataFrame, words: DataFrame, buckets: int, ends: int, doc_id: str = "doc_id", text: str = "text", name: str = "ppm") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score and score. ends: training texts."""
    spark = docs.sparkSession
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    head = words.filter(F.col("n") >= floor_for(words, HEAD)).select("key", "n").toArrow()
    often = strings.filter(F.col("n") >= floor_for(strings, NODES)).select("key", "seen").toArrow()
    tables = [HashTable(np.asarray(t.column("key")).view(np.uint64)) for t in (often, head)]
    shared = spark.sparkContext.broadcast((*tables, np.append(np.asarray(often.column("seen")), 0), np.append(np.asarray(head.column("n")), 0)))

    def run(batches):
        likely, known, seen, counts = shared.value
        logs = np.log10(counts + 1.0)
        logs[-1] = 0.0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offs = text_arrays(batch.column("text"))
            out: dict[str, list] = {c: [] for c in ("score", "words", "known", "head")}
            far, far_edges = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            tail, tail_edges = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in blocks(offs):
                part, edges = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                context, symbol, first = symbols(part, edges)
                strings_of = (context << np.uint64(9)) | symbol
                at = likely.find(strings_of)
                out["score"].append(np.add.reduceat(seen[at], first))
                far.append(strings_of[at < 0])
                far_edges.append(np.add.reduceat((at < 0).astype(np.int64), first))
                starts, ends_at, doc = word_bounds(part, edges)
                hashes = word_hashes(part, starts, ends_at)
                at = known.find(hashes)
                out["words"].append(np.bincount(doc, minlength=j - i))
                out["known"].append(np.bincount(doc, at >= 0, j - i))
                out["head"].append(np.bincount(doc, logs[at], j - i))
                tail.append(hashes[at < 0])
                tail_edges.append(np.bincount(doc[at < 0], minlength=j - i))
            n = batch.num_rows
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(e))]), pa.int32()), pa.array(np.concatenate(v).view(np.int64))) for v, e in ((far, far_edges), (tail, tail_edges))]
            columns = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column("id"), batch.column("held"), pa.array(columns["words"].astype(np.int64)), pa.array(columns["known"].astype(np.int64)), pa.array(columns["head"].astype(float)), pa.array(columns["score"].astype(float)), *lists],
                names=["row", "id", "held", "words", "known", "head", "score", "far", "tail"],
            )
            row += n

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), held_out(doc_id).alias("held"), F.col(text).alias("text"))
    first = written(rows.mapInArrow(tidy(run), "row bigint, id bigint, held boolean, words bigint, known bigint, head double, score double, far array<bigint>, tail array<bigint>"), f"{name}-scores")
    rare = first.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("m")).join(words, "key")
    rare = rare.groupBy("row").agg(F.sum("m").alias("rare_known"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("rare"))
    far = looked_up(first.select("row", "far"), strings, buckets)
    tokens = F.col("words") + 1
    base = F.col("head") + F.coalesce("rare", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - tokens * F.lit(math.log10(total + kinds + 1))
    return first.drop("far", "tail").join(rare, "row", "left").join(far, "row", "left").select(
        F.col("id").alias(doc_id), F.col("held").alias("held_out"), tokens.alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lessons = docs.filter(~held_out("doc_id") & F.col("doc_id").isNotNull())
    strings, words, buckets = train(lessons)
    return scored(docs, strings, words, buckets, lessons.count())
