"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A block of text that numpy arrays are made for at once.
BLOCK_BYTES = 1 << 18
BLOCK_DOCS = 4095
#: Rows and bytes that Python gets at once, which bounds the memory beside the heap.
SMALL_BATCHES = {"maxRecordsPerBatch": 2000, "maxBytesPerBatch": 4 << 20}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_WORD_CODE = _BYTE_CODE[_LOWER]
_POWERS: list[np.ndarray] = []
_LEAN: list[bool] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where that is unset and all
    tasks run in the driver's process (tests). On a cluster it must be set: other machines would not see such a folder."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.checkpoint.dir"):
        return conf.get("spark.checkpoint.dir")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return shared_dir.own


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: int):
    """Session settings of spark.sql.execution.arrow for a while; those of the session come back."""
    names = {f"spark.sql.execution.arrow.{k}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python are as small as those of written(): for an application that hands on, not
    written yet, rows whose columns all pass through Python."""
    for k, v in SMALL_BATCHES.items():
        spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and outlives executors. Batches for Python are kept small
    meanwhile, which bounds the memory beside the heap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    with _settings(spark, **SMALL_BATCHES):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quillon_path = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Removes tables that written() made, once nothing reads them any more."""
    for table in tables:
        if path := getattr(table, "_quillon_path", None):
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def _lean() -> None:
    """Large arrays of this worker get pages of their own, which go back to the system when they are freed."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
            library = ctypes.CDLL(None)
            library.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
            library.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f):
    """f over the batches of a task; a worker gives the memory that a task has freed back to the system at its end."""

    def run(batches):
        _lean()
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


def tidied(f, *tables):
    """f of a group's tables, for applyInArrow; frees memory as tidy() does."""
    _lean()
    try:
        return f(*tables)
    finally:
        _give_back()


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, size: int = BLOCK_BYTES, docs: int = BLOCK_DOCS):
    """Ranges of documents of about `size` bytes; a longer document is a block of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + docs, n)
        yield i, j
        i = j


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def scatter(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, bytes of each column) for each bucket present: few rows for Spark to shuffle, whatever the number of values."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        yield (int(bucket[a]), *(c[a:b].tobytes() for c in columns))


def gather(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """The values of all rows of a column that scatter() made."""
    return np.frombuffer(text_arrays(column)[0].tobytes(), dtype)


def squeeze(data: bytes) -> bytes:
    """Zstandard, after the size as 8 bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data[:8].strip(b"\0") else b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64; those for a block are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    made = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, BLOCK_BYTES + 1), b, np.uint64))]) for b in (_BASE, inverse)]
    if n <= BLOCK_BYTES + 2:
        _POWERS[:] = made
    return made[0], made[1]


def word_bounds(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; words end at separators and at documents' ends."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    edge = np.zeros(len(data) + 2, bool)
    edge[offs + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = _WORD_CODE) -> np.ndarray:
    """64-bit hashes of the words, from prefix sums of a polynomial in an odd base, a block at a time. The usual code
    lower-cases A-Z."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        part = data[starts[i] : ends[j - 1]]
        power, inverse = _powers(len(part) + 1)
        terms = np.take(code, part)
        terms *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document as sorted 52-bit hashes, and where each document's begin.

    A document of fewer words has its whole sequence as one shingle, one without words has none. At most
    BLOCK_DOCS documents: the upper 12 bits hold the document while all are sorted at once.
    """
    docs = len(offs) - 1
    starts, ends, doc = word_bounds(data, offs, separator)
    words = word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(count)])
    c = np.uint64(0xD6E8FEB86659FD93)
    keys = [np.zeros(0, np.uint64)]
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * c + words[k : len(words) - n + 1 + k]
        whole = doc[: len(h)] == doc[n - 1 :]
        keys.append((doc[: len(h)][whole].astype(np.uint64) << np.uint64(52)) | (mix64(h[whole]) >> np.uint64(12)))
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = np.uint64(count[d])
        with np.errstate(over="ignore"):
            for w in words[first[d] : first[d + 1]]:
                h = h * c + w
        keys.append((np.array([d], np.uint64) << np.uint64(52)) | (mix64(np.array([h], np.uint64)) >> np.uint64(12)))
    keys = distinct(np.concatenate(keys))
    edges = np.searchsorted(keys, np.arange(docs + 1, dtype=np.uint64) << np.uint64(52))
    return keys & np.uint64((1 << 52) - 1), edges


def binary_column(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def total_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one number for the driver."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
