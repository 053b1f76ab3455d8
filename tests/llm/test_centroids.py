"""Centroid clustering against its SQL and a plain version, on odd rows."""

import hashlib
import sys
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

from quillon.llm import centroids  # noqa: E402


def plain(rows, k=16, rounds=3):
    """Exact integers and all distances."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))[:k]
    at = [list(v) for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(at)):
            part = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if part:
                at[j] = [sum(col) // len(part) for col in zip(*part)]
    own = assign()
    per = {j: sum(d for d, c in own if c == j) for j in range(len(at))}
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, own)), key=repr)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(centroids.OP11_SQL)
    got = centroids.op11(spark, sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k if k % 9 else k - 1, rng.normal(size=64).round(2).tolist()) for k in range(60)]  # some ids repeat
    good += [(100, good[0][1]), (101, good[0][1]), (None, good[3][1]), (102, [0.0] * 64), (103, [-0.001] * 64), (104, [9e6] + [0.5] * 63)]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [1.0] * 63 + [float("nan")]), (206, [1.0] * 63 + [float("inf")]), (207, [1e30] * 64)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "cells": F.lit(1), "distance": F.lit(2)}).repartition(5)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=repr) == plain(good)


def test_few_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=repr) == plain(rows)
    assert centroids.cluster(df.filter("vec_id > 9")).collect() == []


def test_abandoned_only_when_strictly_above():
    """Ties between centroids that only the last dimensions reveal go to the smaller number, in every order of dimensions."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        x, c = rng.integers(-2, 3, (50, 12)), rng.integers(-2, 3, (9, 12))
        c[5] = c[2]
        distances = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own, best = centroids.nearest(x, c, (2, 5))
        assert (best == distances.min(axis=1)).all() and (own == distances.argmin(axis=1)).all()
