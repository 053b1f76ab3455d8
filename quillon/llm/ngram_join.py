"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct n-word shingles. Tokens have one global order, rare before frequent, so a document's prefix
holds its rarest shingles. If the overlap of two sets must be at least t, the first |x| - t + l tokens of both share at
least l: documents lengthen their prefix (a larger l) where their estimated candidate cost is lower for it, and a pair must
share as many prefix tokens as the smaller l of the two before it is verified.

Steps:
1. One pass gives each set's size, fingerprint and parity bitmap and counts shingles that repeat within a chunk; the HEAVY
   most frequent of those sums (a fixed bound, broadcast) give the order. The order only steers cost: any order gives the
   same links. Equal sets are one class; a second fingerprint tells whether the first ever joins unequal sets, in which case
   the pass runs again with another salt.
2. A second pass chooses l and sends prefix tokens, once a class, to buckets by token. Frequent tokens are dealt over
   sub-buckets. Tokens that one class alone holds go no further.
3. Classes are grouped by their smallest shared token, in tiles of at most TILE, and verified there; groups are then
   bridged by a few representatives of each component. What is linked needs no more comparisons.
4. Pairs from different components that share enough prefix tokens are candidates. A candidate whose bitmaps differ in more
   bits than the sets may differ in elements cannot be similar (equal elements cancel out, so every bit that differs stands
   for an element of one set alone); all others are verified by their sets.
5. Tokens of more than HOT classes do not emit pairs: their classes are compared in tiles, by bitmap, unless one component
   holds them all. First in tiles that each class enters once, dealt by chance in two ways; of a tile's candidates only a
   forest that would connect its components is verified. Then exactly: classes outside a token's largest component meet
   all its classes of like size, and every candidate that still joins different components is verified.
Only links that connect are kept; connected components give the result.

Defined cases: null, empty or wordless texts have no shingles and link with nothing; fewer than n words: the whole sequence
is one shingle; rows with equal doc_ids count as one document; a null doc_id links with nothing and has no component; empty
tables give an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, distinct_counts, forget, gather, mix64, scatter, shingle_sets, text_arrays, tidied, tidy, written
from ._components import components
from .embedding_dedup import spanning_forest

#: Most frequent shingles that are broadcast with their counts.
HEAVY = 1 << 19
#: A shingle counts as repeated when it has so many documents in a chunk of CHUNK shingles.
REPEATED, CHUNK = 3, 2 << 20
#: Tokens of more classes are compared in tiles instead of by emitted pairs.
HOT = 64
TILE = 512
LONGEST = 4
LEAST_BITS = 256
#: Tokens in a bucket, on average, and id lists that are broadcast at most.
BUCKET, BROADCAST_IDS = 1_000_000, 250_000
_SALT = np.uint64(0x9FB21C651E98DF25)


def least_overlap(a, b, percent: int):
    """Smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def fingerprints(keys: np.ndarray, edges: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix64(keys ^ (_SALT + np.uint64(2 * salt))), out=sums[1:])
    return mix64((sums[edges[1:]] - sums[edges[:-1]]) ^ np.diff(edges).astype(np.uint64)).view(np.int64)


def bitmaps(keys: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """A parity bitmap of each set, of a power of two of bits, some two to four an element: an element turns one bit over."""
    size = np.diff(edges)
    bits = np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    spot = np.repeat(first[:-1], size) + (keys & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(spot, minlength=int(first[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((first[:-1] // 8).tolist(), (first[1:] // 8).tolist(), strict=True)]


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) in `width` words: the bitmap of fewer bits is the halves of the longer one turned over."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def most_apart(a, b, percent: int):
    """Most elements that only one of two similar sets of these sizes has."""
    return a + b - 2 * least_overlap(a, b, percent)


def profile(docs: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """Rows (kind 0: id, size, two fingerprints and bitmap of a document) and (kind 1: a repeated shingle, its count, nulls)."""
    names = ["kind", "id", "n", "fp", "other", "bits"]

    def run(batches):
        pending, held = [], 0

        def repeated():
            token, count = distinct_counts(np.concatenate(pending) if pending else np.zeros(0, np.uint64))
            often = count >= REPEATED
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.array(token[often].view(np.int64)), pa.array(count[often]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=names)

        for batch in batches:
            data, offs = text_arrays(batch.column(1))
            sizes, prints, others, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, j in blocks(offs):
                keys, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                sizes.append(np.diff(edges))
                prints.append(fingerprints(keys, edges, salt))
                others.append(fingerprints(keys, edges, salt + (1 << 20)))
                bits += bitmaps(keys, edges)
                pending.append(keys)
                held += len(keys)
                if held >= CHUNK:
                    yield repeated()
                    pending, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), batch.column(0), *(pa.array(np.concatenate(x)) for x in (sizes, prints, others)), pa.array(bits, pa.binary())], names=names)
        yield repeated()

    return docs.mapInArrow(tidy(run), "kind tinyint, id bigint, n bigint, fp bigint, other bigint, bits binary")


def frequent(counts: DataFrame, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of (id, n), at most `most`, as sorted tokens and their counts."""
    sums = written(counts.groupBy("id").agg(F.sum("n").alias("n")), "shingle-counts")
    level = F.floor(F.log2("n") * 8).cast("int")
    found, total = None, 0
    for r in sorted(sums.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a few hundred levels
        total += r["count"]
        if total > most:
            break
        found = r["level"]
    if found is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = sums.filter(level >= found).toArrow()
    forget(sums)
    tokens, n = np.asarray(table.column("id")).view(np.uint64), np.asarray(table.column("n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


class TokenOrder:
    """The order of tokens: those not known as frequent by hash, then the others by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[tokens & np.uint64((1 << 22) - 1)] = True

    def frequency(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if len(self.tokens):
            some = np.flatnonzero(self.maybe[keys & np.uint64((1 << 22) - 1)])
            at = np.minimum(np.searchsorted(self.tokens, keys[some]), len(self.tokens) - 1)
            hit = self.tokens[at] == keys[some]
            out[some[hit]] = self.counts[at[hit]]
        return out


def prefixes(keys: np.ndarray, edges: np.ndarray, order: TokenOrder, percent: int):
    """Prefix tokens of each set: (set, token, its place, its frequency), and each set's number of matches asked for."""
    size = np.diff(edges)
    doc = np.repeat(np.arange(len(size)), size)
    freq = order.frequency(keys)
    often = freq > 0
    rare = np.flatnonzero(~often)
    many_rare = np.bincount(doc[rare], minlength=len(size))
    place = np.zeros(len(keys), np.int64)
    place[rare] = np.arange(len(rare)) - (np.cumsum(many_rare) - many_rare)[doc[rare]]
    some = np.flatnonzero(often)
    some = some[np.lexsort((keys[some], freq[some], doc[some]))]
    many = np.bincount(doc[some], minlength=len(size))
    place[some] = np.arange(len(some)) - (np.cumsum(many) - many)[doc[some]] + many_rare[doc[some]]
    overlap = -(-(percent * size) // 100)
    # Cost of l: entries met under the prefix tokens, and at most that many / l candidates to verify.
    best, ask = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for l in range(1, LONGEST + 1):
        reach = size - overlap + l
        inside = some[place[some] < reach[doc[some]]]
        met = np.bincount(doc[inside], freq[inside] - 1, len(size))
        cost = np.where(l <= overlap, met * (1 + size / (8 * l)), np.inf)
        ask = np.where(cost < best, l, ask)
        best = np.minimum(best, cost)
    take = np.flatnonzero(place < (size - overlap + ask)[doc])
    return doc[take], keys[take], place[take], freq[take], ask


def prefix_runs(docs: DataFrame, order: TokenOrder, buckets: int, n: int, percent: int, salt: int) -> DataFrame:
    """Prefix tokens by bucket, each class once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    schema = "bucket int, token binary, fp binary, size binary, place binary, ask binary, deal binary"

    def run(batches):
        order, seen, pending = shared.value, set(), []

        def flush():
            token, fp, size, place, ask, deal = (np.concatenate(x) for x in zip(*pending, strict=True))
            bucket = (mix64(token + deal.astype(np.uint64) * _SALT) % np.uint64(buckets)).astype(np.int64)
            rows = list(scatter(bucket, token, fp, size, place, ask, deal))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=["bucket", "token", "fp", "size", "place", "ask", "deal"])

        for batch in batches:
            data, offs = text_arrays(batch.column(0))
            for i, j in blocks(offs):
                keys, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                fp, size = fingerprints(keys, edges, salt), np.diff(edges)
                doc, token, place, freq, ask = prefixes(keys, edges, order, percent)
                fresh = np.zeros(len(size), bool)
                for k, x in enumerate(fp.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                keep = np.flatnonzero(fresh[doc])
                doc, freq = doc[keep], freq[keep]
                parts = np.where(freq > HOT, -(-freq // TILE), 0)
                deal = np.where(parts > 0, 1 + fp[doc].view(np.uint64) % np.maximum(parts, 1).astype(np.uint64), 0)
                pending.append((token[keep], fp[doc], size[doc].astype(np.int32), place[keep].astype(np.int32), ask[doc].astype(np.int8), deal.astype(np.int32)))
            if sum(len(x[0]) for x in pending) > 500_000:
                yield flush()
                pending = []
        if pending and sum(len(x[0]) for x in pending):
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), schema)


def shared_tokens(runs: DataFrame) -> DataFrame:
    """(token, fp, size, place, ask, hot) of the prefix tokens that more than one class has."""

    def meet(table):
        token, fp = gather(table.column("token"), np.uint64), gather(table.column("fp"), np.int64)
        size, place, ask, salt = (gather(table.column(c), t) for c, t in (("size", np.int32), ("place", np.int32), ("ask", np.int8), ("deal", np.int32)))
        order = np.lexsort((fp, salt, token))
        same = np.zeros(len(order), bool)
        t, f, s = token[order], fp[order], salt[order]
        same[1:] = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
        again = same.copy()
        again[1:] &= f[1:] == f[:-1]
        order = order[~again]
        group = np.cumsum(~same)[~again] - 1
        count = np.bincount(group)[group] if len(group) else group
        keep = (count > 1) | (salt[order] > 0)
        order, hot = order[keep], (count[keep] > HOT) | (salt[order[keep]] > 0)
        return pa.table({"token": token[order].view(np.int64), "fp": fp[order], "size": size[order], "place": place[order], "ask": ask[order], "hot": hot})

    schema = "token bigint, fp bigint, size int, place int, ask tinyint, hot boolean"
    return runs.groupBy("bucket").applyInArrow(lambda table: tidied(meet, table), schema)


def _tile_links(keys: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, of different sides if there are two, that reach the similarity."""
    size = np.array([len(k) for k in keys])
    flat, doc = np.concatenate(keys), np.repeat(np.arange(len(keys)), size)
    order = np.argsort(flat)
    flat, doc = flat[order], doc[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    column, doc = (np.cumsum(often) - 1)[column[keep]], doc[keep]
    both = np.zeros((len(keys), len(keys)), np.float32)
    width = 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(keys), width), np.float32)
        m[doc[lo:hi], column[lo:hi] - a] = 1
        both += m @ m.T
    near = both * (100 + percent) >= percent * (size[:, None] + size[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    if side.max() != side.min():
        apart = side[i] != side[j]
        i, j = i[apart], j[apart]
    # Exact in integers; sums of ones are exact in single precision up to 2**24.
    shared = both[i, j].astype(np.int64)
    good = 100 * shared >= percent * (size[i] + size[j] - shared)
    return i[good], j[good]


def _maybe_similar(bits: list[bytes], size: np.ndarray, percent: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a[k], b[k]) may be similar by their bitmaps and sizes, and in how many bits they differ."""
    width = np.array([len(x) // 8 for x in bits])
    differ = np.zeros(len(a), np.int64)
    out = np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
    narrow = np.minimum(width[a], width[b])
    for w in sorted({int(x) for x in narrow[out]}):
        wide = {int(x): np.flatnonzero(width == x) for x in set(width.tolist()) if x >= w}
        flat = np.zeros((len(bits), w), np.uint64)
        for x, own in wide.items():
            flat[own] = folded(np.frombuffer(b"".join(bits[k] for k in own.tolist()), "<u8").reshape(len(own), x), w)
        mine = np.flatnonzero(out & (narrow == w))
        for i in range(0, len(mine), max(1, (1 << 20) // w)):
            k = mine[i : i + max(1, (1 << 20) // w)]
            differ[k] = np.bitwise_count(flat[a[k]] ^ flat[b[k]]).sum(axis=1, dtype=np.int64)
            out[k] = differ[k] <= most_apart(size[a[k]], size[b[k]], percent)
    return out, differ


def cheapest_forest(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Edges (a[k], b[k]) of a spanning forest of least cost (ties: the first), whose number is below that of the nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, taken = ends[: len(a)], ends[len(a) :], np.zeros(len(a), bool)
    part = np.arange(len(nodes))
    while True:
        live = np.flatnonzero(part[a] != part[b])
        if not len(live):
            return np.flatnonzero(taken)
        live = live[np.argsort(cost[live], kind="stable")]
        # The cheapest edge that leaves each part.
        sides, edges = np.concatenate([part[a[live]], part[b[live]]]), np.concatenate([np.arange(len(live))] * 2)
        best = np.full(len(nodes), len(live))
        np.minimum.at(best, sides, edges)
        chosen = live[np.unique(best[best < len(live)])]
        taken[chosen] = True
        for x, y in zip(part[a[chosen]].tolist(), part[b[chosen]].tolist(), strict=True):
            x, y = part[x], part[y]
            part[part == max(x, y)] = min(x, y)


class Join:
    """The stages over one set of documents; every table they leave is in the shared folder."""

    def __init__(self, docs: DataFrame, n: int, percent: int, name: str):
        self.docs, self.n, self.percent, self.name = docs, n, percent, name
        for self.salt in range(16):
            seen = written(profile(docs.select("id", "text"), n, self.salt), f"{name}-profile")
            usable = seen.filter("kind = 0 AND n > 0 AND id IS NOT NULL")
            classes = usable.groupBy("fp").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("other").alias("other"), F.max("other").alias("another"))
            self.classes = written(classes, f"{name}-classes")
            if self.classes.filter("other <> another").isEmpty():
                break
            forget(seen, self.classes)  # unequal sets with one fingerprint: another salt
        self.seen = seen
        self.sizes = seen.filter("kind = 0").select("id", "n", "fp")
        total = self.sizes.agg(F.sum("n")).first()[0]
        self.buckets = max(8, -(-int((total or 0) * (100 - percent + 5) / 100) // BUCKET))
        self.order = TokenOrder(*frequent(seen.filter("kind = 1").select("id", "n")))

    def sets(self, members: DataFrame, carry: list[str]) -> DataFrame:
        """members (fp, carried columns) with `keys`, the set as little-endian 64-bit hashes. One pass over the texts."""
        known = written(members.join(self.classes.select("fp", F.col("rep").alias("id")), "fp"), f"{self.name}-ids")
        if known.count() <= BROADCAST_IDS:
            known = F.broadcast(known)
        wanted = self.docs.select("id", "text").join(known, "id").select("fp", *carry, "text")
        n, salt = self.n, self.salt

        def run(batches):
            for batch in batches:
                data, offs = text_arrays(batch.column("text"))
                out, prints = [], [np.zeros(0, np.int64)]
                for i, j in blocks(offs):
                    keys, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                    prints.append(fingerprints(keys, edges, salt))
                    out += [keys[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                right = np.concatenate(prints) == np.asarray(batch.column("fp"))
                columns = [batch.column(k) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "keys"]).filter(pa.array(right))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
        return wanted.mapInArrow(tidy(run), f"{kinds}, keys binary")

    def tiles(self, members: DataFrame) -> DataFrame:
        """Links (a, b) among members (g, lo, hi, part, fp), compared group by group; enough of them to connect."""
        percent = self.percent

        def compare(table):
            fp, part = np.asarray(table.column("fp")), np.asarray(table.column("part"))
            order = np.argsort(fp, kind="stable")
            order = order[np.concatenate([[True], fp[order][1:] != fp[order][:-1]])]  # rows of one doc_id may repeat a set
            fp, part = fp[order], part[order]
            column = table.column("keys").combine_chunks()
            keys = [np.frombuffer(column[k].as_buffer(), np.uint64) for k in order.tolist()]
            i, j = _tile_links(keys, part, percent) if len(keys) > 1 else (np.zeros(0, int),) * 2
            tree = spanning_forest(len(fp), i, j)
            return pa.table({"a": fp[i[tree]], "b": fp[j[tree]]})

        return self.sets(members, ["g", "lo", "hi", "part"]).groupBy("g", "lo", "hi").applyInArrow(lambda t: tidied(compare, t), "a bigint, b bigint")

    def bit_tiles(self, members: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) of members (g, x, y, z, probe, fp, c, size) of a tile that are of different components and may be
        similar by their bitmaps: with `every` all of a probe and another member, else a forest of all members."""
        percent = self.percent

        def compare(table):
            fp, probe, c, size = (np.asarray(table.column(k)) for k in ("fp", "probe", "c", "size"))
            column = table.column("bits").combine_chunks()
            bits = [column[k].as_buffer().to_pybytes() for k in range(len(fp))]
            size = size.astype(np.int64)
            rows, columns = (np.flatnonzero(probe), np.flatnonzero(~probe)) if every else (np.arange(len(fp)),) * 2
            found = [(np.zeros(0, np.int64),) * 3]
            for i in range(0, len(rows), TILE):
                r = rows[i : i + TILE]
                like = np.minimum(size[r][:, None], size[columns]) * 100 >= np.maximum(size[r][:, None], size[columns]) * percent
                a, b = np.nonzero(like & (c[r][:, None] != c[columns]) & (every | (r[:, None] < columns)))
                a, b = r[a], columns[b]
                keep, differ = _maybe_similar(bits, size, percent, a, b) if len(a) else (np.zeros(0, bool), np.zeros(0, np.int64))
                found.append((a[keep], b[keep], differ[keep]))
            a, b, differ = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a) and not every:
                tree = cheapest_forest(c[a], c[b], differ)
                a, b = a[tree], b[tree]
            return pa.table({"a": np.minimum(fp[a], fp[b]), "b": np.maximum(fp[a], fp[b])})

        found = members.join(self.classes.select("fp", "bits"), "fp").select("g", "x", "y", "z", "probe", "fp", "c", "size", "bits")
        return found.groupBy("g", "x", "y", "z").applyInArrow(lambda t: tidied(compare, t), "a bigint, b bigint")

    def maybe(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that may be similar by their bitmaps."""
        percent = self.percent
        known = lambda s: self.classes.select(F.col("fp").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))

        def check(batches):
            for batch in batches:
                k = batch.num_rows
                bits = batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist()
                size = np.concatenate([np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))])
                keep = _maybe_similar(bits, size, percent, np.arange(k), k + np.arange(k))[0] if k else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

        both = pairs.join(known("a"), "a").join(known("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
        return both.mapInArrow(tidy(check), "a bigint, b bigint")

    def compatible(self, a: Column, b: Column) -> Column:
        """Whether sizes a <= b can reach the similarity."""
        return a * 100 >= b * self.percent

    def grouped(self, rows: DataFrame) -> DataFrame:
        """(g, fp, size) as single tiles: each group dealt into parts of about TILE classes of like size; lone ones go."""
        parts = rows.groupBy("g").agg(F.ceil(F.count("*") / TILE).alias("parts"))
        dealt = rows.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        order = Window.partitionBy("g", "part").orderBy("size", "fp")
        # A run of like sizes is a tile of its own.
        near = dealt.withColumns({"near": F.coalesce(self.compatible(F.lag("size").over(order), F.col("size")), F.lit(False)), "with_next": F.coalesce(self.compatible(F.col("size"), F.lead("size").over(order)), F.lit(False))})
        near = near.filter("near OR with_next").withColumn("run", F.sum((~F.col("near")).cast("int")).over(order))
        return near.select("g", F.col("part").alias("lo"), F.col("run").cast("int").alias("hi"), F.lit(0).alias("part"), "fp")

    def links(self) -> DataFrame:
        """Links (a, b) between fingerprints that connect all that are connected, and no others."""
        name, percent = self.name, self.percent
        runs = prefix_runs(self.docs.select("text"), self.order, self.buckets, self.n, percent, self.salt)
        shared = written(shared_tokens(runs), f"{name}-shared")
        # Smallest shared token of each class: near copies mostly agree in it.
        first = shared.groupBy("fp").agg(F.min(F.struct(F.xxhash64("token"), "token"))["token"].alias("g"), F.min("size").alias("size"))
        first = written(first, f"{name}-first")
        found = written(self.tiles(self.grouped(first)), f"{name}-links")
        comps = self.mapped(found)
        # A few classes of each component and group stand for it where a group has several.
        known = first.join(comps, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
        rank = F.row_number().over(Window.partitionBy("g", "c").orderBy(F.xxhash64("fp")))
        several = known.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).filter(f"x <> y AND m > {TILE}").select("g")
        stand = known.join(several, "g", "left_semi").withColumn("r", rank).filter("r <= 8").select("g", "fp", "size")
        found = found.unionByName(written(self.tiles(self.grouped(stand)), f"{name}-bridges"))
        comps = self.mapped(found)
        placed = written(shared.join(comps, "fp", "left").withColumn("c", F.coalesce("c", "fp")), f"{name}-placed")
        hot_held = placed.filter("hot").groupBy("fp").agg(F.count("*").alias("held"))
        cold = placed.filter("NOT hot").join(hot_held, "fp", "left").fillna(0, ["held"])
        mixed = cold.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("token")
        cold = cold.join(mixed, "token", "left_semi")
        left, right = (cold.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("fp", "size", "place", "ask", "c", "held")]) for s in "ab")
        need = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
        ask = F.least("ask_a", "ask_b")
        bound = ask + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) - 1
        pairs = left.join(right, "token").filter((F.col("fp_a") < F.col("fp_b")) & (F.col("c_a") != F.col("c_b")) & self.compatible(F.least("size_a", "size_b"), F.greatest("size_a", "size_b")) & (bound >= need))
        pairs = pairs.groupBy(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).agg(F.count("*").alias("met"), F.min(ask - F.least("held_a", "held_b")).alias("asked")).filter("met >= asked").select("a", "b")
        found = found.unionByName(self.linked(self.maybe(pairs)))
        frequent = shared.filter("hot").select("token", "fp", "size")
        news = True
        for turn in range(0 if frequent.isEmpty() else 3):
            if turn == 1 and not news:  # the components are as they were
                continue
            if news:
                placed = written(frequent.join(self.mapped(found), "fp", "left").withColumn("c", F.coalesce("c", "fp")), f"{name}-placed")
            members = self.dealt(placed, turn) if turn < 2 else self.crossed(placed)
            more = self.linked(self.bit_tiles(members, turn == 2).distinct())
            found, news = found.unionByName(more), not more.isEmpty()
        forget(first)
        return found

    def linked(self, candidates: DataFrame) -> DataFrame:
        candidates = written(candidates, f"{self.name}-pairs")
        return written(self.verified(candidates), f"{self.name}-late")

    def dealt(self, placed: DataFrame, turn: int) -> DataFrame:
        """The classes (token, fp, size, c) of frequent tokens that join components, each in one tile of its token."""
        several = placed.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.ceil(F.count("*") / TILE).alias("parts")).filter("x <> y").select("token", "parts")
        part = F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("parts")).cast("int")
        return placed.join(several, "token").select(F.col("token").alias("g"), part.alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.lit(False).alias("probe"), "fp", "c", "size")

    def crossed(self, placed: DataFrame) -> DataFrame:
        """The same classes in tiles in which every two of different components and like size meet, the one as a probe: those
        outside a token's largest component go to all tiles of their own band of sizes and the two beside it."""
        largest = placed.groupBy("token", "c").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count("*").alias("parts")).filter("parts > 1").select("token", "most")
        # Sizes that can reach the similarity are in one band or in neighbouring ones (bands are a little wider than that).
        banded = placed.join(largest, "token").withColumn("band", F.floor(F.log("size") / (1.001 * math.log(100 / self.percent))).cast("int"))
        tiles = banded.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE).alias("parts"))
        probes = banded.filter("c <> most").select("token", "fp", "c", "size", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
        groups = probes.groupBy("token", "band").agg(F.ceil(F.count("*") / (4 * TILE)).alias("groups"))
        tiles = written(tiles.join(groups, ["token", "band"]), f"{self.name}-tiles")
        spread = lambda rows, own, across, probe: rows.join(tiles, ["token", "band"]).select(
            F.col("token").alias("g"), F.col("band").alias("x"), F.pmod(F.xxhash64("fp"), F.col(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(across).cast("int") - 1)).alias("across"), F.lit(probe).alias("probe"), "fp", "c", "size"
        )
        base = spread(banded, "parts", "groups", False).withColumnsRenamed({"own": "y", "across": "z"})
        return base.unionByName(spread(probes, "groups", "parts", True).withColumnsRenamed({"own": "z", "across": "y"})).select("g", "x", "y", "z", "probe", "fp", "c", "size")

    def mapped(self, found: DataFrame) -> DataFrame:
        return components(found, f"{self.name}-c").select(F.col("id").alias("fp"), F.col("component").alias("c"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        ids = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        sets = written(self.sets(ids, []).dropDuplicates(["fp"]), f"{self.name}-sets")
        percent = self.percent
        both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("keys").alias("y")), "b")

        def check(batches):
            for batch in batches:
                x, y = batch.column("x"), batch.column("y")
                good = np.zeros(batch.num_rows, bool)
                for k in range(batch.num_rows):
                    p, q = np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([p, q]))
                    shared = int((both[1:] == both[:-1]).sum())
                    good[k] = 100 * shared >= percent * (len(p) + len(q) - shared)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

        return both.select("a", "b", "x", "y").mapInArrow(tidy(check), "a bigint, b bigint")


def near_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, name: str = "ngrams") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of at least percent / 100."""
    join = Join(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), n, percent, name)
    by_print = join.links()
    reps = join.classes.select("fp", "rep")
    edges = by_print.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # Rows that share a doc_id are one document, whose sets are linked through it.
    usable = join.sizes.filter("n > 0 AND id IS NOT NULL")
    several = usable.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("id")
    edges = edges.unionByName(usable.join(several, "id").select("id", "fp").distinct().join(reps, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = components(edges, f"{name}-all")
    whole = written(reps.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component")), f"{name}-whole")
    out = join.sizes.join(whole, (F.col("fp") == F.col("f")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
