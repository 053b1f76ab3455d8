"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label collapse to one representative with a number of copies. Vectors are normalised and rotated to the
principal axes; each label's vectors are dealt over chunks of about TILE rows, and each pair of chunks is one tile, a group
of bounded size. In a tile the leading dimensions are multiplied first; what the others can add is at most the product of
the suffix norms, so a tile, or the pairs of it that remain, stop as soon as no cosine can reach the threshold. What
survives all dimensions is decided by the cosine of the vectors themselves in double precision. A tile gives each vector's
number of links and a spanning forest of its links, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a null label or a null
vec_id link with nothing (their component is their own id); repeated rows are copies and link; an id with several vectors has
a row for each, with that vector's own links; vectors of different dimension never link; a cosine of exactly the threshold
links; very long vectors are compared as they are, unrotated beyond the commonest dimensions; empty tables give an empty
result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy, written
from ._components import components

THRESHOLD = 0.93
TILE = 1024
#: Dimensions whose covariance is gathered (its square is all that reaches the driver); others are compared unrotated.
PCA_DIMENSIONS = 4
MARGIN = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling variance, by dimension, from the second moments of all vectors (id, dim, embedding)."""
    dims = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(PCA_DIMENSIONS).collect()]

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            kinds = np.asarray(batch.column("dim"))
            for dim in dims:
                own = np.flatnonzero(kinds == dim)
                if len(own):
                    x = _matrix(batch.column("embedding").take(pa.array(own)), dim)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["dim", "moment"])

    if not dims:
        return {}
    cells = vectors.select("dim", "embedding").mapInArrow(tidy(moments), "dim int, moment array<double>").select("dim", F.posexplode("moment"))
    totals = cells.groupBy("dim", "pos").agg(F.sum("col").alias("s")).collect()
    out = {}
    for dim in {r["dim"] for r in totals}:
        m = np.zeros(dim * dim)
        for r in totals:
            if r["dim"] == dim:
                m[r["pos"]] = r["s"]
        out[dim] = np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].copy()
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x and y whose cosine reaches the threshold."""
    dim = x.shape[1]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = x / nx[:, None], y / ny[:, None]
    if axes is not None:
        u, v = u @ axes, v @ axes
    suffix = [np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], 0)) for m in (u, v)]
    steps = [k for k in (8, 16, 32, 64, 128, 256, 512) if k < dim] + [dim]
    done, partial, pairs = 0, np.zeros((len(x), len(y))), None
    for k in steps:
        if pairs is None:
            partial += u[:, done:k] @ v[:, done:k].T
            most = partial if k == dim else partial + np.outer(suffix[0][:, k], suffix[1][:, k])
            i, j = np.nonzero(most >= threshold - MARGIN)
            if len(i) * 8 < partial.size:
                pairs, partial = (i, j), partial[i, j]
        else:
            i, j = pairs
            partial = partial + np.einsum("ij,ij->i", u[i, done:k], v[j, done:k])
            stay = partial + (0 if k == dim else suffix[0][i, k] * suffix[1][j, k]) >= threshold - MARGIN
            pairs, partial = (i[stay], j[stay]), partial[stay]
        done = k
        if pairs is not None and not len(pairs[0]):
            return pairs
    i, j = pairs if pairs is not None else (i, j)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        keep[b] = np.einsum("ij,ij->i", x[i[b]], y[j[b]]) / (nx[i[b]] * ny[j[b]]) >= threshold
    return i[keep], j[keep]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that join what was apart, at most n - 1."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    kept = []
    for at, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append(at)
            if len(kept) == n - 1:
                break
    return kept


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    groups = rows.filter(usable).groupBy("label", "embedding").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    # An id may have several vectors, so a group has a number of its own, which the written table fixes.
    groups = written(groups.withColumns({"dim": F.size("embedding"), "rep": F.monotonically_increasing_id()}), "vectors")
    axes = spark.sparkContext.broadcast(principal_axes(groups))
    # Chunks: a label's number of them follows from its count; a chunk's rows are dealt by hash.
    sizes = groups.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    dealt = groups.join(sizes, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")})

    def compare(key, table):
        lo, hi, dim = key[2].as_py(), key[3].as_py(), key[1].as_py()
        chunk = np.asarray(table.column("chunk"))
        ids, copies = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
        data = _matrix(table.column("embedding").combine_chunks(), dim)
        first, second = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        i, j = linked_pairs(data[first], data[second], axes.value.get(dim), threshold)
        i, j = first[i], second[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(links)
        tree = spanning_forest(len(ids), i, j)
        none = pa.nulls(len(some), pa.int64())
        return pa.table({
            "a": pa.chunked_array([pa.array(ids[some], pa.int64()), pa.array(ids[i[tree]], pa.int64())]),
            "b": pa.chunked_array([none, pa.array(ids[j[tree]], pa.int64())]),
            "links": pa.chunked_array([pa.array(links[some].astype(np.int64)), pa.array(np.zeros(len(tree), np.int64))]),
        })

    found = spread.select("label", "dim", "lo", "hi", "chunk", "rep", "copies", "embedding").groupBy("label", "dim", "lo", "hi").applyInArrow(compare, "a bigint, b bigint, links bigint")
    found = written(found, "vector-links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("b IS NOT NULL").select("a", "b"), "vector-components")
    lowest = parts.join(groups.select(F.col("rep").alias("id"), "low"), "id").groupBy("component").agg(F.min("low").alias("lowest"))
    parts = parts.join(lowest, "component").select(F.col("id").alias("rep"), F.col("lowest").alias("component"))
    reps = groups.join(links, "rep", "left").join(parts, "rep", "left")
    reps = reps.select(F.col("label").alias("r_label"), F.col("embedding").alias("r_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "low").alias("c"))
    good = rows.filter(usable).join(reps, (F.col("label") == F.col("r_label")) & (F.col("embedding") == F.col("r_embedding"))).select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = rows.filter(~usable).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
