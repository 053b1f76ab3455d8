"""Token-id output as Simple-8b blocks.

Documents are range-partitioned by doc_id, encoded a batch at a time, and their ids packed into 64-bit words: a 4-bit
selector says how many ids of how many bits the other 60 hold; selector 15 is an escape, its id follows as a whole word.
A block holds BLOCK_IDS ids (the last of a batch fewer) and starts on a word of its own, so packing and unpacking run over
all blocks of a batch at once, and any block can be decoded alone.

File format: a table in Parquet, one row a batch of documents: part, seq (its place in the part), doc_ids, n_tokens (ids
of each document, end id included), block_ids and block_words (per block: ids held, first word), words (little-endian
64-bit). Rows in order of (part, seq) hold documents in ascending doc_id.

Encoding: a text's words are what its ASCII white space separates; the tokenizer never joins ids across white space, so
each distinct word is encoded once per worker, and the ids of a text are those of its words. Words are split between a
letter and an ASCII sign behind it too, where the tokenizer's own pattern ends a run of letters. Words of ASCII bytes alone are folded to lower case
first; all others reach the tokenizer as they are, since it composes letters and marks before it folds. Texts are encoded
SLICE bytes at a time, cut between words, so a long text takes no more memory than a short one.

Defined cases: null text: only the end id; null doc_ids come first; equal doc_ids are ordered by text; an empty table
gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import _BYTE_CODE, _LOWER, _SPACE, text_arrays, tidy, total_bytes, word_hashes, written

#: Ids per word and bits per id, by selector 0 to 14.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
BLOCK_IDS = 1024
#: Words whose ids a worker keeps (some 60 MB).
CACHE_WORDS = 1_500_000
#: Bytes of text that are encoded at once, and that an output partition holds.
SLICE, PART_BYTES = 1 << 20, 16 << 20
#: Blocks that are packed at once.
PACK_BLOCKS = 1024
FILE_SCHEMA = "part int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, block_ids array<int>, block_words array<bigint>, words binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, ids per block and first word of each block. ids: unsigned integers."""
    words, held, first, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for i in range(0, len(ids), PACK_BLOCKS * BLOCK_IDS):
        w, h, f = _pack_blocks(ids[i : i + PACK_BLOCKS * BLOCK_IDS])
        words.append(w)
        held.append(h)
        first.append(f + at)
        at += len(w)
    return np.concatenate(words), np.concatenate(held), np.concatenate(first)


def _pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    wide = BLOCK_IDS + COUNTS[0]
    table = np.zeros((blocks, wide), np.uint64)
    held = np.full(blocks, BLOCK_IDS)
    if n % BLOCK_IDS:
        held[-1] = n % BLOCK_IDS
    body = np.zeros(blocks * BLOCK_IDS, np.uint64)
    body[:n] = ids
    table[:, :BLOCK_IDS] = body.reshape(blocks, BLOCK_IDS)
    bits = np.zeros(table.shape, np.uint8)
    rest = table.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << s)
        bits += (big * s).astype(np.uint8)
        rest >>= big.astype(np.uint64) * np.uint64(s)
    bits += rest.astype(np.uint8)
    # The first selector, of those with most ids, whose ids all fit; padding has 0 bits.
    choice = np.full((blocks, BLOCK_IDS), ESCAPE, np.uint8)
    most, width = bits, 1
    for count in sorted(set(COUNTS)):
        while width * 2 <= count:
            most = np.maximum(most[:, : most.shape[1] - width], most[:, width:])
            width *= 2
        most_here = np.maximum(most[:, :BLOCK_IDS], most[:, count - width : count - width + BLOCK_IDS])
        k = COUNTS.index(count)
        choice = np.where(most_here <= BITS[k], np.uint8(k), choice)
    counts = np.array([*COUNTS, 1])
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    steps = []
    while len(live):
        pick = choice[live, at[live]]
        steps.append((live, at[live].copy(), pick))
        at[live] += counts[pick]
        live = live[at[live] < held[live]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    block, start, pick = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((start, block))
    block, start, pick = block[order], start[order], pick[order]
    place = np.cumsum(1 + (pick == ESCAPE)) - 1 - (pick == ESCAPE)
    words = np.zeros(len(pick) + int((pick == ESCAPE).sum()), np.uint64)
    flat, base = table.reshape(-1), block * wide + start
    for k in range(16):
        own = np.flatnonzero(pick == k)
        if not len(own):
            continue
        if k == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[own] + 1] = flat[base[own]]
            continue
        word = np.full(len(own), k, np.uint64) << np.uint64(60)
        for j in range(COUNTS[k] if BITS[k] else 0):
            word |= flat[base[own] + j] << np.uint64(j * BITS[k])
        words[place[own]] = word
    return words, held.astype(np.int32), place[np.searchsorted(block, np.arange(blocks))]


def unpack(words: np.ndarray, held: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids of all blocks, in order."""
    if not len(words):
        return np.zeros(0, np.uint64)
    pick = (words >> np.uint64(60)).astype(np.uint8)
    # A word after an escape is an id, not a selector; in a run of words that look like escapes they take turns.
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(pick == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    pick = pick[heads]
    counts = np.array([*COUNTS, 1])[pick]
    block = np.searchsorted(first, heads, "right") - 1
    ends = np.cumsum(counts)
    origin = np.concatenate([[0], ends])[np.searchsorted(heads, first)]
    out = np.zeros(int(ends[-1]), np.uint64)
    for k in range(16):
        own = np.flatnonzero(pick == k)
        if not len(own):
            continue
        to = ends[own] - counts[own]
        if k == ESCAPE:
            out[to] = words[heads[own] + 1]
            continue
        word = words[heads[own]]
        for j in range(COUNTS[k] if BITS[k] else 0):
            out[to + j] = (word >> np.uint64(j * BITS[k])) & np.uint64((1 << BITS[k]) - 1)
    inside = np.arange(len(out)) - np.repeat(origin[block], counts) < np.repeat(held[block].astype(np.int64), counts)
    return out[inside]


_STOP = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[]^_`{}~"))
#: Second bytes of the letters À to ÿ.
_LATIN = np.isin(np.arange(256), [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)])
_LETTER = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the pieces that are encoded alone."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    stop = np.flatnonzero(_STOP[data])
    before = data[np.maximum(stop - 1, 0)]
    cut[stop[(_LETTER[before] | (_LATIN[before] & (data[np.maximum(stop - 2, 0)] == 0xC3) & (stop > 1))) & (stop > 0)]] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def slices(data: np.ndarray, offs: np.ndarray):
    """(first byte, end, first document, end) of slices of about SLICE bytes that end between documents, or between words of
    a long one (behind a space; a longer word stays whole)."""
    i, at, n = 0, int(offs[0]), len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, at + SLICE, "right")) - 1
        if j > i:
            yield at, int(offs[j]), i, j
            i, at = j, int(offs[j])
            continue
        end = min(at + SLICE, int(offs[i + 1]))
        while end < offs[i + 1]:
            space = np.flatnonzero(_SPACE[data[end : end + SLICE]])
            end = min(end + (int(space[0]) + 1 if len(space) else SLICE), int(offs[i + 1]))
            if len(space):
                break
        yield at, end, i, i + 1
        at = end
        if end == offs[i + 1]:
            i += 1


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased in the words that hold neither a byte from 0x80 on nor a special token's first sign."""
    odd = data >= 0x80
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # <|
    if not odd.any():
        return _LOWER[data]
    many = np.concatenate([[0], np.cumsum(odd)])
    raw = many[ends] > many[starts]
    edge = np.bincount(starts[raw], minlength=len(data) + 1) - np.bincount(ends[raw], minlength=len(data) + 1)
    return np.where(np.cumsum(edge)[:-1] > 0, data, _LOWER[data])


class WordEncoder:
    """Encodes texts through their distinct words; ids of words seen before are kept by the words' 64-bit hashes."""

    #: Stands between words that are encoded together; a word that holds it is encoded alone.
    MARK = "\x01"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        # Words of small ASCII letters are one word of the model's, unless these show that the tokenizer treats them otherwise.
        self.direct = all(self._word(w).tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("a", "the", "strength", "zzqx", "internationalization", "abcdefghijklmnopqrstuvwxyz"))
        self.forget()

    def forget(self) -> None:
        # Two tables, the small one of new words: hashes in order, where each word's ids begin, and how many they are.
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))] * 2
        self.ids, self.held = np.zeros(1 << 16, np.uint32), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each word (sorted hashes), -1 for new ones."""
        begin, length = np.full(len(keys), -1, np.int32), np.zeros(len(keys), np.int32)
        for known, at, n in self.tables:
            if len(known):
                spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[spot] == keys
                begin[hit], length[hit] = at[spot[hit]], n[spot[hit]]
        return begin, length

    def _learn(self, keys: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        def joined(a, b):
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")
            return tuple(x[order] for x in both)

        self.tables[1] = joined(self.tables[1], (keys, begin, length))
        if len(self.tables[1][0]) > 20_000 + len(self.tables[0][0]) // 4:
            self.tables = [joined(*self.tables), (keys[:0], begin[:0], length[:0])]

    def _word(self, word: str) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(word)], np.uint32)

    def _encode_new(self, words: list[str]) -> list[np.ndarray]:
        alone = lambda w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
        out: dict[int, np.ndarray] = {k: alone(w) for k, w in enumerate(words) if self.MARK in w}
        if self.direct:
            out.update((k, self._word(w)) for k, w in enumerate(words) if w.isascii() and w.isalpha() and w.islower())
        plain = [k for k in range(len(words)) if k not in out]
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        joined = self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(words[k] for k in g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, joined, strict=True):
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) != 1 or len(cuts) != len(group) - 1:
                out.update((k, alone(words[k])) for k in group)
            else:
                out.update((k, ids[a:b]) for k, a, b in zip(group, [0, *(cuts + 1)], [*cuts, len(ids)], strict=True))
        return [out[k] for k in range(len(words))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        data, offs = text_arrays(texts)
        ids, count = [np.zeros(0, np.uint32)], np.zeros(len(offs) - 1, np.int64)
        for a, b, i, j in slices(data, offs):
            found, n = self._slice(data[a:b], np.clip(offs[i : j + 1] - a, 0, b - a))
            ids.append(found)
            count[i:j] += n
        return np.concatenate(ids), count

    def _slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, doc = split_words(data, offs)
        data = folded(data, starts, ends)
        keys = word_hashes(data, starts, ends, _BYTE_CODE)
        if sum(len(t[0]) for t in self.tables) > CACHE_WORDS:
            self.forget()
        order = np.argsort(keys)
        keys = keys[order]
        first = np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])
        which = np.empty(len(keys), np.int32)
        which[order] = np.cumsum(first) - 1
        keys, sample = keys[first], order[first]
        begin, length = self._find(keys)
        new = np.flatnonzero(begin < 0)
        if len(new):
            raw = data.tobytes()
            pieces = self._encode_new([raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in sample[new].tolist()])
            length[new] = np.fromiter(map(len, pieces), np.int32, len(pieces))
            begin[new] = self.held + np.cumsum(length[new]) - length[new]
            fresh = np.concatenate(pieces)
            if self.held + len(fresh) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.held], np.zeros(max(len(self.ids), 2 * len(fresh)), np.uint32)])
            self.ids[self.held : self.held + len(fresh)] = fresh
            self.held += len(fresh)
            self._learn(keys[new], begin[new], length[new])
        each = length[which].astype(np.int64)
        ends_at = np.cumsum(each)
        ids = self.ids[np.repeat(begin[which] - (ends_at - each), each) + np.arange(int(ends_at[-1]) if len(ends_at) else 0)]
        return ids, np.bincount(doc, each, len(offs) - 1).astype(np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text", name: str = "tokens") -> DataFrame:
    """Writes the ids of all documents in the file format, in ascending doc_id, and returns the files as a table."""
    parts = max(1, -(-total_bytes(docs, text) // PART_BYTES))
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = narrow.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def encode(batches):
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offs = text_arrays(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + 2 * SLICE, "right")) - 1)
                ids, n = encoder.encode(batch.column("text").slice(i, j - i))
                ids, n = with_end(ids, n, end_id)
                words, held, first = pack(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([seq], pa.int32()), _one_list(batch.column("id").slice(i, j - i), pa.int64()), _one_list(n, pa.int64()),
                        _one_list(held, pa.int32()), _one_list(first, pa.int64()), pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    ],
                    names=["part", "seq", "doc_ids", "n_tokens", "block_ids", "block_words", "words"],
                )
                seq += 1
                i = j

    return written(ordered.mapInArrow(tidy(encode), FILE_SCHEMA), name)


def _one_list(values, kind) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each document's."""
    if end_id is None:
        return ids, n
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = ids
    return out, n + 1


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, decoded from the files: part, seq, nth (its place in the row), doc_id, n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers), and on request the ids."""

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, row=row, batch=batch: batch.column(name)[row]
                n = get("n_tokens").values.to_numpy(zero_copy_only=False)
                words = np.frombuffer(get("words").as_buffer(), "<u8")
                ids = unpack(words, get("block_ids").values.to_numpy(zero_copy_only=False), get("block_words").values.to_numpy(zero_copy_only=False))
                data = memoryview(ids.astype("<u4").tobytes())
                edges = np.concatenate([[0], np.cumsum(n)])
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                k = len(n)
                columns = [pa.array(np.full(k, get("part").as_py()), pa.int32()), pa.array(np.full(k, get("seq").as_py()), pa.int32()), pa.array(np.arange(k), pa.int32()), get("doc_ids").values, pa.array(n, pa.int64()), pa.array(sums, pa.int64())]
                names = ["part", "seq", "nth", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "part int, seq int, nth int, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return files.mapInArrow(tidy(decode), schema)


def document_starts(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds `start`: ids of all documents before each. Rows of the files (one for 2 MB of text) give the starts of rows; a
    running sum inside a row gives the rest."""
    rows = files.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_part = rows.groupBy("part").agg(F.sum("n").alias("n"))
    parts = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = rows.select("part", "seq", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("row_start")).join(parts, "part")
    in_row = Window.partitionBy("part", "seq").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return documents.withColumn("in_row", F.coalesce(F.sum("n_tokens").over(in_row), F.lit(0))).join(starts, ["part", "seq"]).withColumn("start", F.col("part_start") + F.col("row_start") + F.col("in_row"))


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return document_starts(files, read_tokens(files)).select("doc_id", "start", "n_tokens", "ids_crc32")
