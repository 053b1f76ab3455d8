"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size, [2^j, 2^(j+1)) shingles. An item's signature is the bottom-k MinHash of its shingle
set; k is one more than the shingles that an item of its partition may lack, so a document that contains at least
`threshold` of an item must hold one of its signature's values: no item is missed, however long the document. A partition
is searched in the documents that have as many shingles as its smallest item needs; the others skip it. Each candidate pair
is verified by exact containment of the shingles' words.

Words are runs of letters and digits (any non-ASCII character counts as one), A-Z lower-cased; shingles have n words, and
an item of m < n words has shingles of m. Distinct item texts come in blocks of BLOCK_ITEMS at most, each block's index is
broadcast and searched in one pass over the documents: no shingle of a document is shuffled. Hits carry the text's digest;
a join on it gives the ids of all items with that text.

Defined cases: null or wordless texts and items match nothing; null ids are carried; repeated rows give repeated pairs of
documents, and equal items, however many, are pairs of their own; empty tables give an empty result; other columns do not
matter, and a column of the documents that has the name of a result's column gives way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, distinct, shingle_sets, text_arrays, tidy

BLOCK_ITEMS = 20_000
SHINGLE, THRESHOLD = 5, Fraction(4, 5)

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_a:_b] = False
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def exact_shingles(text: bytes, n: int) -> set[bytes]:
    words = _TOKEN.findall(text.lower())  # bytes.lower() is A-Z only
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


class ItemIndex:
    """Signatures of a block of distinct item texts, by words of a shingle and by size."""

    def __init__(self, texts: list[str], n: int = SHINGLE, threshold: Fraction = THRESHOLD):
        self.threshold = threshold
        raw = [t.encode() for t in texts]
        self.digest = [hashlib.sha256(t).hexdigest() for t in raw]
        length = [min(n, len(_TOKEN.findall(t))) for t in raw]
        self.exact: list[set[bytes]] = [exact_shingles(t, m) if m else set() for t, m in zip(raw, length, strict=True)]
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for k, m in enumerate(length):
            if m:
                data = np.frombuffer(raw[k], np.uint8)
                found, _ = shingle_sets(data, np.array([0, len(data)]), m, _BREAK)
                classes.setdefault((m, len(found).bit_length()), []).append((k, found))
        #: Per words of a shingle: of each size class the shingles its smallest item needs, signature values, items, filter.
        self.by_length: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (m, level), members in sorted(classes.items()):
            # The most that an item of the class may lack, at its largest size (and at any below, for rounding).
            most_lacking = max(s - math.ceil(threshold * s) for s in {(1 << level) - 1, *(len(f) for _, f in members)})
            hashes = np.concatenate([f[: most_lacking + 1] for _, f in members])  # sorted: these are the smallest
            rows = np.concatenate([np.full(min(len(f), most_lacking + 1), k) for k, f in members])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << max(16, int(len(hashes) * 64).bit_length()), bool)
            seen[hashes & np.uint64(len(seen) - 1)] = True
            need = min(math.ceil(threshold * len(f)) for _, f in members)
            self.by_length.setdefault(m, []).append((need, hashes[order], rows[order], seen))

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, item's shingles, shared) of pairs with enough containment, in a block of documents."""
        out = []
        for m, classes in self.by_length.items():
            every, edges = shingle_sets(data, offs, m, _BREAK)
            sizes = np.diff(edges)
            pairs = [np.zeros(0, np.int64)]
            for need, hashes, rows, seen in classes:
                enough = sizes >= need
                if not enough.any():
                    continue
                maybe = seen[every & np.uint64(len(seen) - 1)]
                if not enough.all():
                    maybe &= np.repeat(enough, sizes)
                maybe = np.flatnonzero(maybe)
                left, right = np.searchsorted(hashes, every[maybe], "left"), np.searchsorted(hashes, every[maybe], "right")
                hit = right > left
                maybe, left, right = maybe[hit], left[hit], right[hit]
                if len(maybe):
                    reps = right - left
                    items = rows[np.repeat(left - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
                    doc = np.searchsorted(edges, maybe, "right") - 1
                    pairs.append(distinct(np.repeat(doc, reps) * len(self.exact) + items))
            last, held = -1, set()
            for d, k in np.stack(np.divmod(np.sort(np.concatenate(pairs)), max(1, len(self.exact))), axis=1).tolist():
                if d != last:
                    last, held = d, exact_shingles(data[offs[d] : offs[d + 1]].tobytes(), m)
                shared = len(self.exact[k] & held)
                if shared >= self.threshold * len(self.exact[k]):
                    out.append((d, k, len(self.exact[k]), shared))
        return out


def item_blocks(items: DataFrame, item_text: str, n: int, threshold: Fraction):
    """Broadcast indexes of at most BLOCK_ITEMS distinct texts each, one after another."""
    texts = items.select(F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    parts = max(1, -(-texts.count() // (BLOCK_ITEMS // 2)))
    for part in range(parts):
        block = texts if parts == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        rows = block.limit(2 * BLOCK_ITEMS).collect()  # half of BLOCK_ITEMS is expected, and no text comes twice
        if len(rows) >= 2 * BLOCK_ITEMS:
            raise ValueError(f"a block of {parts} holds {2 * BLOCK_ITEMS} test items")
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], n, threshold))


def batch_hits(index: ItemIndex, texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, item, item's shingles, shared) of a batch."""
    data, offs = text_arrays(texts)
    found = []
    for i, j in blocks(offs):
        found += [(i + d, k, size, both) for d, k, size, both in index.search(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
    return found


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: Fraction = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """One row for each (document, item) whose containment reaches the threshold: the carried columns (default: doc_id),
    item_id, n_shingles of the item, n_shared and containment."""
    made = ["item_id", "n_shingles", "n_shared", "containment"]
    carry = [c for c in carry or [doc_id] if c not in made]
    source = docs.select(*carry, F.col(text).alias("_q_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)
    schema = f"{kinds}_q_item string, n_shingles bigint, n_shared bigint, containment double"
    hits = None
    for shared in item_blocks(items, item_text, n, threshold):

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                if found := batch_hits(index, batch.column("_q_text")):
                    d, k, size, both = zip(*found, strict=True)
                    take = pa.array(d, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(take) for c in range(batch.num_columns - 1)), pa.array([index.digest[x] for x in k]), pa.array(size, pa.int64()), pa.array(both, pa.int64()), pa.array([b / s for b, s in zip(both, size, strict=True)])],
                        names=[*batch.schema.names[:-1], "_q_item", "n_shingles", "n_shared", "containment"],
                    )

        more = source.mapInArrow(tidy(run), schema)
        hits = more if hits is None else hits.unionByName(more)
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.sha2(F.col(item_text), 256).alias("_q_item"))
    return hits.join(named, "_q_item").select(*carry, *made)


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with their columns: one pass for each block of items, no shuffle."""
    place = docs.columns.index(text)
    for shared in item_blocks(items, item_text, n, threshold):

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in batch_hits(shared.value, batch.column(place))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op1(spark, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id AS id, 0 AS kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
items AS (SELECT id, len(words) AS n, least(5, len(words)) AS m, words FROM w WHERE kind = 1 AND len(words) > 0),
item_shingles AS (SELECT DISTINCT id, m, array_to_string(words[i:i + m - 1], ' ') AS s FROM (SELECT id, m, words, unnest(range(1, n - m + 2)) AS i FROM items)),
sizes AS (SELECT id, count(*) AS n_shingles FROM item_shingles GROUP BY id),
doc_shingles AS (
  SELECT DISTINCT id, m, array_to_string(words[i:i + m - 1], ' ') AS s
  FROM (SELECT w.id, l.m, words, unnest(range(1, len(words) - l.m + 2)) AS i FROM w, (SELECT DISTINCT m FROM items) l WHERE kind = 0 AND len(words) >= l.m)),
shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM doc_shingles d JOIN item_shingles i ON d.s = i.s AND d.m = i.m GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM shared JOIN sizes ON item_id = sizes.id WHERE 5 * n_shared >= 4 * n_shingles
"""
