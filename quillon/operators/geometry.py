"""Geometry of drawings: corners, boxes, hulls, the nearest rectangle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The four corners of a rectangle turned about its centre, as array<struct<x,y>>."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    turned = lambda i, j: F.struct((cx + i * w / 2 * c - j * h / 2 * s).alias("x"), (cy + i * w / 2 * s + j * h / 2 * c).alias("y"))
    return F.array(turned(-1, -1), turned(1, -1), turned(1, 1), turned(-1, 1))


def bounding_box(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def distance(px: Column, py: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """From a point to an upright rectangle, 0 inside."""
    return F.hypot(F.greatest(F.abs(px - cx) - w / 2, F.lit(0.0)), F.greatest(F.abs(py - cy) - h / 2, F.lit(0.0)))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of sorted distinct points, counter-clockwise from the smallest; points on an edge are left out."""
    if len(points) < 3:
        return points

    def chain(run):
        out = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def convex_hull(df: DataFrame, key: str, x: str, y: str, slices: int = 64) -> DataFrame:
    """(key, position, x, y): corners of each key's hull. Null and NaN points are left out.

    Points are reduced twice: first the hull of each slice of a key, then the hull of those corners, so a key with most
    rows is spread over the slices.
    """
    kind = df.schema[key].dataType.simpleString()
    points = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")

    def corners_of(rows: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(sorted(set(zip(rows["x"], rows["y"]))))
        return pd.DataFrame({"k": [rows["k"].iloc[0]] * len(hull), "position": range(len(hull)), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})

    shape = f"k {kind}, position int, x double, y double"
    part = F.pmod(F.xxhash64("x", "y"), F.lit(slices)).alias("slice")
    first = points.groupBy("k", part).applyInPandas(corners_of, shape)
    return first.groupBy("k").applyInPandas(corners_of, shape).withColumnRenamed("k", key)
