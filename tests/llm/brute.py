"""Plain versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_documents(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    met = Counter()
    for group in by.values():
        group = sorted(group)
        for a in range(len(group)):
            for b in range(a):
                met[group[b], group[a]] += 1
    links = [(a, b) for (a, b), m in met.items() if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m)]
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def repeats(docs, window=50):
    """doc_id -> (bytes, removed, spans, sha256 of the rest)"""
    first = {}
    raw = {i: (t or "").encode() for i, t in docs}
    for i in sorted(raw):
        for p in range(len(raw[i]) - window + 1):
            first.setdefault(raw[i][p : p + window], i)
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def unigram_base(docs):
    """doc_id -> (held_out, n_tokens, n_known, N, base)"""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    count = Counter()
    for i, t in docs:
        if not held[i]:
            count.update(words(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) for i, w in ((i, [*words(t), None]) for i, t in docs)}


def ppm(docs, order=5):
    """doc_id -> score by all strings of the training texts: escapes by method C, symbol exclusion"""
    end, tables, known = 256, defaultdict(Counter), {}

    def places(t):
        data = [*(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()), end]
        padded = [10] * order + data
        return [(tuple(padded[i : i + order]), x) for i, x in enumerate(data)]

    def cost(context, x):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            table = tables.get(context[order - k :], {})
            left = {y: n for y, n in table.items() if y not in gone}
            if x in left:
                return out + math.log10(left[x] / (sum(left.values()) + len(left)))
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
            gone |= set(table)
        return out - math.log10(max(1, 257 - len(gone)))

    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for context, x in places(t):
                for k in range(order + 1):
                    tables[context[k:]][x] += 1
    return {i: sum(known[p] if p in known else known.setdefault(p, cost(*p)) for p in places(t)) for i, t in docs}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m) for m in EMAIL.finditer(text)]
    found += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in found]


def spark_hash(*values):
    """What Spark's xxhash64 gives of strings and 64-bit integers, null ones left out."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def shards(docs, n=16, slices=8192, vnodes=128):
    """Shard of every (doc_id, text) in order: a ring with n * vnodes points, shares at most one apart."""
    points = defaultdict(set)
    for k in range(n * vnodes):
        points[k % n].add(spark_hash("vnode", k % n, k // n) % slices)
    place = [spark_hash("text", t) if i is None else spark_hash("key", i) for i, t in docs]
    held = defaultdict(list)
    for k, p in enumerate(place):
        held[p % slices].append(k)
    room = [len(docs) // n + (k < len(docs) % n) for k in range(n)]
    out = [None] * len(docs)
    for s in sorted(held, key=lambda s: spark_hash("turn", s)):
        clockwise = sorted(range(n), key=lambda k: (min((p - s) % slices for p in points[k]), k))
        for k in sorted(held[s], key=lambda k: (place[k], docs[k][0] is not None, docs[k][0] or 0, spark_hash(docs[k][1]))):
            out[k] = next(x for x in clockwise if room[x])
            room[out[k]] -= 1
    return out


def phrases(sample, text):
    """Longest matches that cover a text, each the longest that starts there and occurs in the sample; unknown bytes count one."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n
