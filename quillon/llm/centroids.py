"""Centroid clustering of integer vectors by partial-distance search.

Components become integers, so every distance and every mean is exact and reruns agree. Dimensions are visited by falling
variance over all vectors. For a vector, the squared differences over the leading dimensions are added up for every centroid;
the most promising one is finished first and gives the best distance so far; the others go on a few dimensions at a time and
are abandoned once their sum is strictly above it. Those that remain finish all dimensions, and the smaller number wins a tie.
A round sends k rows a task (count and sums) through Spark's partial aggregation; the driver sees k sums, never a vector.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out, and so are those
whose integer components' squares add up to 2**60 or more (their distances need not fit 64 bits); fewer vectors than k give as
many centroids; repeated rows are rows of their own (as seeds too: equal hashes go by components); a null vec_id is clustered
but seeds only behind all others; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, forget, gather, tidy, written

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = "1"
#: Dimensions after which candidates are weighed again.
STEPS = (8, 16, 32)
BLOCK = 4096
MOST_SQUARES = float(1 << 60)


def integers(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their components floor(scale * x); every list has dim elements."""
    values = column.flatten()
    whole = np.asarray(values.is_valid()).reshape(-1, dim).all(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * np.asarray(values.fill_null(0.0), np.float64).reshape(-1, dim))
        kept = np.flatnonzero(whole & (np.einsum("ij,ij->i", x, x) < MOST_SQUARES))
    return kept, x[kept].astype(np.int32)


def nearest(x: np.ndarray, centroids: np.ndarray, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, for each row; dimensions in the order to be visited."""
    dim = x.shape[1]
    edges = [s for s in steps if s < dim] + [dim]
    lead = edges[0]
    partial = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(lead):
        gap = x[:, d, None] - centroids[None, :, d]
        partial += gap * gap
    cluster, rows = partial.argmin(axis=1), np.arange(len(x))
    rest = x[:, lead:] - centroids[cluster, lead:]
    best = partial[rows, cluster] + np.einsum("ij,ij->i", rest, rest)
    partial[rows, cluster] = np.iinfo(np.int64).max
    i, j = np.nonzero(partial <= best[:, None])
    sums = partial[i, j]
    for a, b in zip(edges, edges[1:], strict=False):
        gap = x[i, a:b] - centroids[j, a:b]
        sums = sums + np.einsum("ij,ij->i", gap, gap)
        stay = sums <= best[i]
        i, j, sums = i[stay], j[stay], sums[stay]
    order = np.lexsort((j, sums, i))
    i, j, sums = i[order], j[order], sums[order]
    first = np.concatenate([np.ones(min(1, len(i)), bool), i[1:] != i[:-1]])
    i, j, sums = i[first], j[first], sums[first]
    wins = (sums < best[i]) | (j < cluster[i])
    cluster[i[wins]], best[i[wins]] = j[wins], sums[wins]
    return cluster, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return gather(column, np.int32).reshape(-1, dim).astype(np.int64)


def _integer_rows(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: float) -> DataFrame:
    def convert(batches):
        for batch in batches:
            kept, x = integers(batch.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), binary_column([row.tobytes() for row in x])], names=["vec_id", "cells"])

    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).filter(F.size("embedding") == dim)
    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(tidy(convert), f"vec_id {kind}, cells binary")


def _variances(rows: DataFrame, dim: int) -> np.ndarray:
    """Variance of each dimension over all rows; only their order is used."""

    def moments(batches):
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[*s, *q]], pa.list_(pa.float64()))], names=["n", "sums"])

    parts = rows.select("cells").mapInArrow(tidy(moments), "n long, sums array<double>")
    total = parts.agg(F.sum("n"), *[F.sum(F.col("sums")[k]) for k in range(2 * dim)]).first()
    n, sums = total[0] or 0, np.array([v or 0.0 for v in total[1:]])
    mean = sums[:dim] / max(n, 1)
    return sums[dim:] / max(n, 1) - mean * mean


def _means(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; empty ones stay."""
    dim, k = centroids.shape[1], len(centroids)
    near = centroids[:, order]

    def sums(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                cluster, _ = nearest(part[:, order], near)
                by = np.argsort(cluster, kind="stable")
                groups, first = np.unique(cluster[by], return_index=True)
                total[groups] += np.add.reduceat(part[by], first, axis=0)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.select("cells").mapInArrow(tidy(sums), "cluster int, n long, sums array<long>")
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("sums")[d].cast("decimal(20,0)")) for d in range(dim)]).collect():
        out[row[0]] = [int(v) // row[1] for v in row[2:]]
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, seed: str = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = written(_integer_rows(vectors, vec_id, embedding, dim, scale), "cluster-cells")
    seeds = rows.orderBy(F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "cells").limit(k).collect()
    centroids = np.array([np.frombuffer(r["cells"], np.int32) for r in seeds], np.int64).reshape(-1, dim)
    order = np.argsort(-_variances(rows, dim), kind="stable")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _means(rows, centroids, order)
    near = centroids[:, order]
    kind = dict(rows.dtypes)["vec_id"]

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for a in range(0, len(x), BLOCK):
                own, distance = nearest(x[a : a + BLOCK][:, order], near)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, BLOCK), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = written(rows.mapInArrow(tidy(assign), f"vec_id {kind}, cluster int, distance long"), "cluster-rows")
    forget(rows)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = vectors.sparkSession.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string")
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    total = sum(r["cluster_inertia"] for r in per)
    inertia = vectors.sparkSession.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in per], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(inertia.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same rounds as common table expressions; % and / of integers truncate in the dialect, so floors are written out."""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {CENTROIDS}
)"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, cluster, d FROM (
    SELECT vec_id, v, cluster, CAST(list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c{r}
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1
)""")  # fmt: skip
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
    FROM (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {DIMENSIONS + 1}) AS p(i) GROUP BY cluster, i) GROUP BY cluster
  ) m ON m.cluster = c{r}.cluster
)""")  # fmt: skip
    return ", ".join(steps) + f"""
SELECT vec_id, a{ROUNDS}.cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{ROUNDS}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = a{ROUNDS}.cluster"""  # fmt: skip


OP11_SQL = _sql()
