"""Suffix-array deduplication: repeated strings of WINDOW bytes, found by a common-prefix-aware distributed merge sort.

Every byte goes that a WINDOW-byte string covers which also starts in a document with a smaller id.

Sparse suffixes: the smallest hash of GRAM bytes within each window marks an anchor, so every window holds one, and equal
windows hold the same. Only suffixes at anchors are sorted, and of them only those whose anchor occurs in two documents.

1. Anchors: each task sends the sorted hashes of its anchors, with the document group they lie in, to buckets by hash; a
   bucket answers each group with the hashes that lie in more than one document.
2. Suffix runs: each document group meets its answers (a cogroup), cuts the suffixes at shared anchors (WINDOW bytes to the
   right, WINDOW - GRAM to the left), sorts them, keeps one document of equal ones (the others are repeats for certain), and
   sends front-coded runs, the bytes that differ from the entry before, to buckets by anchor.
3. Merge: a bucket merges its runs with a loser tree that knows the common prefix of every loser with the winner it lost to;
   a comparison starts behind it and never looks at known bytes again. The merge leaves the common prefixes of neighbours.
4. Windows: neighbours that share WINDOW - o bytes to the right and o to the left hold the same window; where a smaller
   document has it, its bytes go. The spans meet their documents (a cogroup) and are cut out.

Document groups and buckets hold about GROUP_BYTES of text, so their number grows with the input. A passage that many
documents share reaches a bucket once per group.

Defined cases: null text: empty; texts shorter than the window keep all; a null doc_id is larger than any id, and rows of
equal ids do not remove each other's bytes; empty tables give an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _powers, distinct, expand, gather, mix64, scatter, squeeze, text_arrays, tidied, tidy, total_bytes

WINDOW, GRAM = 50, 24
LEFT = WINDOW - GRAM
WIDE = WINDOW + 1 + LEFT
GROUP_BYTES = 8 << 20
#: Bytes of texts looked at once, and anchors that a task holds before it sends them.
BLOCK, PENDING = 1 << 18, 1_000_000
#: Suffixes whose entries are made at once.
SLICE = 1 << 15
#: Bits of an anchor's hash that are sent; the bucket is told by others.
KEY_BITS = 40
_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_LAST = np.iinfo(np.int64).max


def text_blocks(offs: np.ndarray, size: int = BLOCK):
    """Ranges of whole documents of about `size` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(max(int(np.searchsorted(offs, offs[i] + size, "right")) - 1, i + 1), n)
        yield i, j
        i = j


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all strings of n bytes."""
    power, inverse = _powers(len(data) + 1)
    terms = np.take(_CODE, data)
    terms *= power[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * inverse[: len(data) - n + 1])


def anchors(data: np.ndarray, offs: np.ndarray):
    """(position, hash, document) of the anchors, a block at a time: the places of the smallest hash of each window (all
    places that tie). Where blocks of a long text meet, a place may come twice."""
    step = BLOCK - WINDOW
    for w in range(0, len(data) - WINDOW + 1, step):
        end = min(len(data), w + BLOCK - 1)
        edges = np.concatenate([[w], offs[np.searchsorted(offs, w, "right") : np.searchsorted(offs, end, "left")], [end]])
        at, hashes = _anchors(data[w:end], edges - w)
        yield at + w, hashes, np.searchsorted(offs, at + w, "right") - 1


def _anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = gram_hashes(data)
    many = WINDOW - GRAM + 1
    low, width = hashes, 1
    while width < many:
        step = min(width, many - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    # low[w]: smallest hash of the window at w. Windows do not cross documents.
    inside = np.ones(len(low), bool)
    for edge in offs[1:-1].tolist():
        inside[max(0, edge - WINDOW + 1) : edge] = False
    low = np.where(inside, low, np.uint64(0))
    # A place is an anchor if a window that holds it has its hash as smallest: the largest of those minima equals it.
    most, width = np.concatenate([np.zeros(many - 1, np.uint64), low, np.zeros(many - 1, np.uint64)]), 1
    while width < many:
        step = min(width, many - width)
        most = np.maximum(most[:-step], most[step:])
        width += step
    at = np.flatnonzero(most[: len(hashes)] == hashes)
    return at, hashes[at]


def anchor_runs(docs: DataFrame, buckets: int) -> DataFrame:
    """Per task and bucket: the distinct (hash, group) of anchors, and the hashes that two documents of the task have."""

    def run(batches):
        pending: list[tuple[np.ndarray, ...]] = []

        def flush():
            hashes, group, doc = (np.concatenate(x) for x in zip(*pending, strict=True))
            order = np.argsort(hashes)
            hashes, group, doc = hashes[order], group[order], doc[order]
            first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            run = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            several = np.maximum.reduceat(doc, start) != np.minimum.reduceat(doc, start)
            key = hashes & np.uint64((1 << KEY_BITS) - 1)
            bucket = ((hashes >> np.uint64(KEY_BITS)) % np.uint64(buckets)).astype(np.int64)
            # One entry for each (hash, group).
            order = np.lexsort((group, run))
            fresh = np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (group[order][1:] != group[order][:-1])])
            own = order[fresh]
            raw = np.empty((len(own), 5), np.uint8)
            raw[:] = key[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows = [(b, k, g, s) for b, k, g, s in scatter(bucket[own], raw, group[own].astype("<i4"), several[run[own]].astype(np.uint8))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=["bucket", "key", "grp", "several"])

        held = doc_at = 0
        for batch in batches:
            data, offs = text_arrays(batch.column("text"))
            groups = np.asarray(batch.column("grp"))
            for i, j in text_blocks(offs):
                for at, hashes, doc in anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    if len(at):
                        pending.append((hashes, groups[i + doc], doc + (doc_at + i)))
                        held += len(at)
                    if held > PENDING:
                        yield flush()
                        pending, held = [], 0
            doc_at += batch.num_rows
        if pending:
            yield flush()

    return docs.select("grp", "text").mapInArrow(tidy(run), "bucket int, key binary, grp binary, several binary")


def _keys(column) -> np.ndarray:
    raw = gather(column, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.reshape(-1).view("<u8")


def shared_anchors(runs: DataFrame) -> DataFrame:
    """(grp, bucket, keys) of anchors that more than one document has."""

    def meet(key, table):
        keys, group, several = _keys(table.column("key")), gather(table.column("grp"), "<i4"), gather(table.column("several"), np.uint8)
        order = np.argsort(keys)
        keys, group, several = keys[order], group[order], several[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        # Entries of a hash come from different tasks or groups, so from different documents.
        good = (np.diff(np.append(first, len(keys))) > 1) | (np.maximum.reduceat(several, first) > 0)
        keep = np.repeat(good, np.diff(np.append(first, len(keys))))
        rows = list(scatter(group[keep], keys[keep]))
        return pa.table({"grp": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})

    return runs.groupBy("bucket").applyInArrow(lambda key, table: tidied(meet, key, table), "grp int, bucket int, keys binary")


# Suffix runs -----------------------------------------------------------------------------------------------------------


def suffix_entries(data: np.ndarray, offs: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the suffixes at `at` as rows of bytes, and their lengths: WINDOW bytes from the anchor on (padded), their
    number, and up to LEFT bytes before it, nearest first."""
    right = np.minimum(offs[doc + 1] - at, WINDOW)
    left = np.minimum(at - offs[doc], LEFT)
    table = np.zeros((len(at), WIDE), np.uint8)
    for k in range(WINDOW):
        table[:, k] = np.where(right > k, data[np.minimum(at + k, len(data) - 1)], 0)
    table[:, WINDOW] = right
    for k in range(LEFT):
        table[:, WINDOW + 1 + k] = np.where(left > k, data[np.maximum(at - 1 - k, 0)], 0)
    return table, WINDOW + 1 + left


def once(table: np.ndarray, doc: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's entries, each once a document: their rows, how many ranges of places each has, and the ranges' first and
    last places. Places of a range are at most WINDOW apart, so the windows on them leave no gap. Runs of one byte, or of a
    few that repeat, thus cost an entry or two."""
    spot = np.arange(len(at))
    if len(distinct(hashes ^ mix64(doc.astype(np.uint64)))) > len(at) // 2:  # few repeats at most: each is its own entry
        return spot, np.ones(len(at), np.int64), at, at
    wide = np.ascontiguousarray(np.concatenate([doc.astype(">u4").view(np.uint8).reshape(-1, 4), table], axis=1))
    order = np.argsort(wide.view(f"S{wide.shape[1]}").ravel(), kind="stable")
    wide, place = wide[order], at[order]
    entry = np.concatenate([[True], (wide[1:] != wide[:-1]).any(axis=1)])
    begin = entry | np.concatenate([[True], np.diff(place) > WINDOW])
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(place)) - 1
    return order[entry], np.add.reduceat(begin.astype(np.int64), np.flatnonzero(entry)), place[first], place[last]


def spread(many: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of `many` items laid end to end: the items of lists k, and for each the place in k of its list."""
    reps = many[k]
    begin = (np.cumsum(many) - many)[k]
    return np.repeat(begin - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum())), np.repeat(np.arange(len(k)), reps)


def front_code(table: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes]:
    """Of sorted entries: (common prefix with the entry before, rest's length) pairs, and the rests."""
    place = np.arange(table.shape[1])
    same = np.zeros(len(table), np.int64)
    differ = table[1:] != table[:-1]
    same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    same[1:] = np.minimum(same[1:], np.minimum(size[1:], size[:-1]))
    rest = table[(place >= same[:, None]) & (place < size[:, None])]
    return np.stack([same, size - same], axis=1).astype(np.uint8).tobytes(), rest.tobytes()


def front_decode(head: bytes, rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k in range(0, len(head), 2):
        n = head[k + 1]
        before = before[: head[k]] + rest[at : at + n]
        at += n
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs, each (entries, common prefix with the entry before).

    Returns the (run, place) of the entries in order, and each one's common prefix with the entry before it. A loser tree:
    every loser keeps its common prefix with the winner it lost to. Of two candidates that both lost to the same entry, the
    one with the longer prefix is smaller, unseen; only equal prefixes are compared, from their end on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    entry: list[bytes | None] = [runs[r][0][0] if r < len(runs) and runs[r][0] else None for r in range(k)]
    loser, known = [0] * k, [0] * k

    def play(a: int, ka: int, b: int, kb: int) -> tuple[int, int, int, int]:
        """Of runs a and b, whose prefixes with the last winner are known: winner and its prefix, loser and its with the winner."""
        x, y = entry[a], entry[b]
        if y is None:
            return a, ka, b, 0
        if x is None:
            return b, kb, a, 0
        if ka != kb:
            return (a, ka, b, kb) if ka > kb else (b, kb, a, ka)
        n, most = ka, min(len(x), len(y))
        if x[n:] == y[n:]:
            n = most
        else:
            while n < most and x[n] == y[n]:
                n += 1
        if n == most:
            first = (len(x), a) < (len(y), b)
        else:
            first = x[n] < y[n]
        return (a, ka, b, n) if first else (b, kb, a, n)

    top = [(r, 0) for r in range(k)]  # of the leaves; nothing is known before the first winner
    level, base = top, k
    while len(level) > 1:
        base //= 2
        up = []
        for m in range(len(level) // 2):
            (a, ka), (b, kb) = level[2 * m], level[2 * m + 1]
            win, kw, lose, kl = play(a, ka, b, kb)
            loser[base + m], known[base + m] = lose, kl
            up.append((win, kw))
        level = up
    winner, prefix = level[0]
    order, lcps = [], []
    while entry[winner] is not None:
        order.append((winner, place[winner]))
        lcps.append(prefix)
        place[winner] += 1
        entries, commons = runs[winner]
        at = place[winner]
        if at < len(entries):
            entry[winner], now = entries[at], commons[at]
        else:
            entry[winner], now = None, 0
        node = (winner + k) // 2
        champion, prefix = winner, now
        while node:
            champion, prefix, loser[node], known[node] = play(champion, prefix, loser[node], known[node])
            node //= 2
        winner = champion
    return order, lcps


def suffix_runs(docs: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind 0: (bucket, run of suffixes at shared anchors); kind 1: (group, spans that are repeats for certain)."""

    def cut(key, texts, known):
        shared = np.zeros(0, np.uint64)
        if known.num_rows:
            wide = [np.frombuffer(k.as_py(), "<u8") | (np.uint64(b) << np.uint64(KEY_BITS)) for b, k in zip(known.column("bucket").to_pylist(), known.column("keys"), strict=True)]
            shared = np.sort(np.concatenate(wide))
        ids, rows_of = np.asarray(texts.column("id")), np.asarray(texts.column("row"))
        data, offs = text_arrays(texts.column("text"))
        found = []
        for i, j in text_blocks(offs) if len(shared) else ():
            base = int(offs[i])
            for at, hashes, doc in anchors(data[base : offs[j]], offs[i : j + 1] - base):
                bucket = (hashes >> np.uint64(KEY_BITS)) % np.uint64(buckets)
                short = (hashes & np.uint64((1 << KEY_BITS) - 1)) | (bucket << np.uint64(KEY_BITS))
                spot = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
                hit = np.flatnonzero(shared[spot] == short)
                for k in (hit[x : x + SLICE] for x in range(0, len(hit), SLICE)):
                    table, size = suffix_entries(data, offs, at[k] + base, doc[k] + i)
                    rows, many, first, last = once(table, doc[k], hashes[k], at[k] + base)
                    found.append((table[rows], size[rows], bucket[k][rows].astype(np.int64), doc[k][rows] + i, many, first, last))
        names = ("kind", "target", "head", "rest", "a", "b", "c")
        if not found:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int8(), pa.int32(), *[pa.binary()] * 5), strict=True)})
        table, size, bucket, doc, many, first_at, last_at = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        in_doc = np.repeat(offs[doc], many)
        first_at, last_at = first_at - in_doc, last_at - in_doc
        length, who, row = (offs[1:] - offs[:-1])[doc], ids[doc], rows_of[doc]
        # In order of bucket, entry and id: one sort of byte strings.
        wide = np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), table, (who.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)], axis=1)
        order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel(), kind="stable")
        wide = wide[order, : 4 + WIDE]
        fresh = np.concatenate([[True], (wide[1:] != wide[:-1]).any(axis=1)])
        first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        # The same bytes around the anchor as in a smaller document: all windows on it are repeats.
        again = who[order] != who[first]
        item, k = spread(many, order[again])
        k = order[again][k]
        lo, hi = np.maximum(0, first_at[item] - LEFT), np.minimum(last_at[item] + WINDOW, length[k])
        full = hi - lo - (last_at[item] - first_at[item]) >= WINDOW
        rows = []
        if full.any():
            r, lo, hi = union_spans(row[k][full], lo[full], hi[full])
            rows.append((1, key[0].as_py(), b"", b"", r.astype("<i8").tobytes(), lo.astype("<i8").tobytes(), hi.astype("<i8").tobytes()))
        kept = order[~again]
        edge = np.flatnonzero(np.concatenate([[True], bucket[kept][1:] != bucket[kept][:-1]]))
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(kept)], strict=True):
            k = kept[x:y]
            docs_here = distinct(doc[k])
            named = np.concatenate([ids[docs_here], rows_of[docs_here]]).astype("<i8").tobytes()
            item, _ = spread(many, k)
            which = np.concatenate([np.searchsorted(docs_here, doc[k]), many[k]]).astype("<u4").tobytes()
            ranges = np.concatenate([first_at[item], last_at[item] - first_at[item]]).astype("<i8").tobytes()
            rows.append((0, int(bucket[k[0]]), *map(squeeze, (*front_code(table[k], size[k]), named, which, ranges))))
        kinds = (pa.int8(), pa.int32(), *[pa.binary()] * 5)
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    left, right = docs.groupBy("grp"), answers.groupBy("grp")
    return left.cogroup(right).applyInArrow(lambda key, a, b: tidied(cut, key, a, b), "kind tinyint, target int, head binary, rest binary, a binary, b binary, c binary")


def repeated_windows(entries: list[bytes], lcps: list[int], ids: np.ndarray, row: np.ndarray, many: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, begin, end) of windows that a smaller document has too, of sorted suffixes and their common prefixes.
    many, begin: an entry's ranges of places, and where they begin in first and last."""
    m = len(entries)
    table = np.frombuffer(b"".join(e.ljust(WIDE, b"\0") for e in entries), np.uint8).reshape(m, WIDE)
    right, left = table[:, WINDOW].astype(np.int64), np.array([len(e) for e in entries]) - WINDOW - 1
    sides = np.zeros((m, 32), np.uint8)
    sides[:, :LEFT] = table[:, WINDOW + 1 :]
    lcp = np.array(lcps)
    gone = np.zeros((m, LEFT + 3), bool)
    hashed = np.zeros(m, np.uint64)
    for o in range(LEFT + 1):
        if o:
            hashed = (hashed ^ np.take(_CODE, table[:, WINDOW + o])) * np.uint64(0xD6E8FEB86659FD93)
            hashed ^= hashed >> np.uint64(29)
        fits = np.flatnonzero((right >= WINDOW - o) & (left >= o))
        if not len(fits):
            continue
        group = np.cumsum(np.concatenate([[True], lcp[1:] < WINDOW - o])).astype(np.uint64)
        key = mix64(group[fits] * np.uint64(0x9FB21C651E98DF25) + hashed[fits])
        order = np.argsort(key)
        k = key[order]
        first_of = np.concatenate([[True], k[1:] != k[:-1]])
        # Equal hashes are held against the bytes; should they differ, the bytes themselves are sorted.
        own = fits[order]
        words = sides[own, : -(-o // 8) * 8].copy()
        words[:, o:] = 0
        words = words.view("<u8")
        differ = (group[own][1:] != group[own][:-1]) | (words[1:] != words[:-1]).any(axis=1)
        if (differ & ~first_of[1:]).any():
            order = np.lexsort((*sides[fits, :o].T, group[fits])) if o else np.argsort(group[fits], kind="stable")
            own = fits[order]
            differ = (group[own][1:] != group[own][:-1]) | (sides[own, :o][1:] != sides[own, :o][:-1]).any(axis=1)
            first_of = np.concatenate([[True], differ])
        who = ids[own]
        smallest = np.minimum.reduceat(who, np.flatnonzero(first_of))[np.cumsum(first_of) - 1]
        gone[own[who > smallest], o + 1] = True
    # Runs of neighbouring windows of a suffix are one span.
    k, lo = np.nonzero(gone[:, 1:] & ~gone[:, :-1])
    _, hi = np.nonzero(gone[:, :-1] & ~gone[:, 1:])
    reps = many[k]
    item = np.repeat(begin[k] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
    k, lo, hi = (np.repeat(x, reps) for x in (k, lo, hi))
    return union_spans(row[k], first[item] - (hi - 1), last[item] - lo + WINDOW)


def union_spans(who: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each id (overlapping or touching ones joined); all spans of an id that begin together are sorted by end."""
    if not len(who):
        return who, a, b
    order = np.lexsort((a, who))
    who, a, b = who[order], a[order], b[order]
    # Running end within an id: ids are told apart by an offset larger than any position.
    rank = np.cumsum(np.concatenate([[0], (who[1:] != who[:-1]).astype(np.int64)]))
    wide = int(b.max()) + 1
    ends = np.maximum.accumulate(b + rank * wide)
    new = np.concatenate([[True], (a + rank * wide)[1:] > ends[:-1]])
    new |= np.concatenate([[True], rank[1:] != rank[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(who)) - 1
    return who[first], a[first], ends[last] - rank[last] * wide


def merged_spans(runs: DataFrame, groups: int) -> DataFrame:
    """(target group, spans) of the repeats that the merged runs of each bucket show, and of those found before."""

    def merge(key, table):
        if key[0].as_py():
            return table.select(["target", "a", "b", "c"])
        lists, ids, row, many, first, last = [], [], [], [], [], []
        for line in table.to_pylist():
            head = expand(line["head"])
            lists.append((front_decode(head, expand(line["rest"])), list(head[::2])))
            named, (which, ranges) = np.frombuffer(expand(line["a"]), "<i8").reshape(2, -1), np.frombuffer(expand(line["b"]), "<u4").reshape(2, -1)
            ids.append(named[0][which])
            row.append(named[1][which])
            many.append(ranges.astype(np.int64))
            at, more = np.frombuffer(expand(line["c"]), "<i8").reshape(2, -1)
            first.append(at)
            last.append(at + more)
        order, lcps = merge_runs(lists)
        entries = [lists[r][0][p] for r, p in order]
        begins = np.cumsum([0, *(len(x[0]) for x in lists)])
        flat = np.array([begins[r] + p for r, p in order], np.int64)
        many = np.concatenate(many)
        row, a, b = repeated_windows(entries, lcps, *(np.concatenate(x)[flat] for x in (ids, row)), many[flat], (np.cumsum(many) - many)[flat], np.concatenate(first), np.concatenate(last))
        rows = list(scatter(row % groups, row.astype("<i8"), a.astype("<i8"), b.astype("<i8")))
        out = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int32() if n == "target" else pa.binary()) for n, c in zip(("target", "a", "b", "c"), out, strict=True)})

    return runs.groupBy("kind", "target").applyInArrow(lambda key, table: tidied(merge, key, table), "target int, a binary, b binary, c binary")


def kept_bytes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with the bytes that are left: doc_id, kept (binary), n_bytes, n_removed, n_spans."""

    def cut(texts, known):
        rows = np.asarray(texts.column("row"))
        data, offs = text_arrays(texts.column("text"))
        gone = np.zeros(len(data), bool)
        if known.num_rows:
            who, a, b = union_spans(*(gather(known.column(c), "<i8") for c in "abc"))
            first, last = np.searchsorted(who, rows, "left"), np.searchsorted(who, rows, "right")
            many = last - first
            doc = np.repeat(np.arange(len(rows)), many)
            span = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            edge = np.bincount(offs[doc] + a[span], minlength=len(data) + 1) - np.bincount(offs[doc] + b[span], minlength=len(data) + 1)
            gone = np.cumsum(edge)[:-1] > 0
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        begin = offs[:-1][offs[:-1] < len(data)]
        starts[begin] = gone[begin]
        total, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(starts)])
        kept = data[~gone].tobytes()
        edges = offs - total[offs]
        pieces = [kept[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.table({"doc_id": texts.column("doc_id"), "kept": pa.array(pieces, pa.binary()), "n_bytes": np.diff(offs), "n_removed": total[offs[1:]] - total[offs[:-1]], "n_spans": runs[offs[1:]] - runs[offs[:-1]]})

    left, right = docs.groupBy("grp"), spans.groupBy("grp")
    return left.cogroup(right).applyInArrow(lambda a, b: tidied(cut, a, b), "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, kept (the bytes that are left), n_bytes, n_removed, n_spans."""
    groups = max(1, -(-total_bytes(docs, text) // GROUP_BYTES))
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(_LAST)).alias("id"), F.xxhash64(number, F.col(text)).alias("row"), F.col(text).alias("text"))
    rows = rows.withColumn("grp", F.pmod("row", F.lit(groups)).cast("int"))
    runs = suffix_runs(rows, shared_anchors(anchor_runs(rows, groups)), groups)
    spans = merged_spans(runs, groups).withColumnRenamed("target", "grp")
    return kept_bytes(rows, spans)  # its exchange of the texts is the one that suffix_runs made


def op10(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
