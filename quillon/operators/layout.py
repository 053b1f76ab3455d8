"""Columns of a timeline: intervals that overlap are put side by side.

Each interval takes the lowest column that is free at its start, so it depends on those before it, but only through what is
still open. The rows are cut by ranges of (key, start), every part is packed by itself from the intervals that are open at its
left edge, and hands on those open at its right one. Parts begin with nothing open; those whose left edge turns out otherwise
are packed again, until no edge changes: a round or two where timelines pause now and then, as many as a key has parts at
worst. A key with all rows is many tasks, and only edges, lists of open intervals, pass between them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranged
from .replay import settled

OPEN = "array<struct<until: long, col: int>>"


def pack(rows: list[tuple[int, int]], opened: list[tuple[int, int]]) -> tuple[list[int], list[bool], list[tuple[int, int]]]:
    """Columns of intervals (start, end) in order of starts, whether each begins an island, and what is open behind the last."""
    columns, fresh = [], []
    for start, end in rows:
        opened = [x for x in opened if x[0] > start]
        taken = {col for _, col in opened}
        col = next(k for k in range(len(taken) + 1) if k not in taken)
        fresh.append(not opened)
        columns.append(col)
        opened.append((end, col))
    return columns, fresh, opened


def packed_columns(df: DataFrame, key: str, id_: str, start: str, end: str) -> DataFrame:
    """(key, island, id, col, cols): each interval in the lowest column that is free at its start, its island (from 1, in order
    of time), and the island's columns. Of equal starts the smaller id comes first; a null key is a key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(F.col(key).alias("_k"), F.col(id_).alias("_i"), micros(start).alias("_s"), micros(end).alias("_e"))
    rows = ranged(rows, [F.col("_k"), F.col("_s"), F.col("_i")])
    order = Window.partitionBy("_k").orderBy("_part")  # a row a part of a key
    parts = rows.groupBy("_k", "_part").agg(F.count("*").alias("_n")).withColumns({"_next": F.lead("_part").over(order), "_many": F.count("*").over(Window.partitionBy("_k"))})
    parts = settled(parts)
    edges = settled(parts.select("_k", "_part", F.lit(None).cast(OPEN).alias("_open"), F.lit(True).alias("_new")))

    def opened(states: pd.DataFrame) -> list[tuple[int, int]]:
        held = states["_open"].iloc[0] if len(states) else None
        return [] if held is None else [(x["until"], x["col"]) for x in held]

    def listed(group: pd.DataFrame) -> list[tuple[int, int]]:
        group.sort_values("_at", inplace=True)
        return list(zip(group["_s"].tolist(), group["_e"].tolist(), strict=True))

    def right_edge(group: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(states):
            return pd.DataFrame({"_k": [], "_part": [], "_out": []})
        pairs = listed(group)
        _, _, out = pack(pairs, opened(states))
        return pd.DataFrame({"_k": group["_k"].iloc[:1].tolist(), "_part": group["_part"].iloc[:1].tolist(), "_out": [[{"until": u, "col": c} for u, c in sorted(x for x in out if x[0] > pairs[-1][0])]]})

    outs = None
    several = parts.filter("_many > 1").select(F.col("_k").alias("_mk"), F.col("_part").alias("_mp"), "_next")
    while not several.isEmpty():
        moved = edges.filter("_new").join(several, F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_part") == F.col("_mp")), "left_semi")
        if moved.isEmpty():
            break
        again = rows.join(moved.select(F.col("_k").alias("_mk"), F.col("_part").alias("_mp")), F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_part") == F.col("_mp")), "left_semi")
        made = settled(again.groupBy("_k", "_part").cogroup(moved.groupBy("_k", "_part")).applyInPandas(right_edge, f"_k {kinds[key]}, _part long, _out {OPEN}"))
        rest = None if outs is None else outs.join(made.select(F.col("_k").alias("_mk"), F.col("_part").alias("_mp")), F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_part") == F.col("_mp")), "left_anti")
        outs = settled(made if rest is None else rest.unionByName(made))
        given = outs.join(several, F.col("_k").eqNullSafe(F.col("_mk")) & (F.col("_part") == F.col("_mp"))).filter("_next IS NOT NULL").select(F.col("_k").alias("_gk"), F.col("_next").alias("_gp"), "_out")
        turned = edges.join(given, F.col("_k").eqNullSafe(F.col("_gk")) & (F.col("_part") == F.col("_gp")), "left")
        some = F.when(F.size("_out") > 0, F.col("_out"))
        edges = settled(turned.select("_k", "_part", some.alias("_open"), (~some.eqNullSafe(F.col("_open"))).alias("_new")))

    def place(group: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        columns, fresh, _ = pack(listed(group), opened(states))
        return group.assign(col=columns, _fresh=pd.Series(fresh, index=group.index).cumsum())[["_k", "_part", "_i", "col", "_fresh"]]

    placed = settled(rows.groupBy("_k", "_part").cogroup(edges.groupBy("_k", "_part")).applyInPandas(place, f"_k {kinds[key]}, _part long, _i {kinds[id_]}, col int, _fresh long"))
    before = F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_k", "_part").agg(F.max("_fresh").alias("_m")).withColumn("_before", before).select(F.col("_k").alias("_bk"), F.col("_part").alias("_bp"), "_before")
    numbered = placed.join(starts, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_part") == F.col("_bp"))).select("_k", (F.col("_before") + F.col("_fresh")).alias("island"), "_i", "col")
    widths = numbered.groupBy(F.col("_k").alias("_wk"), F.col("island").alias("_wi")).agg((F.max("col") + 1).alias("cols"))
    out = numbered.join(widths, F.col("_k").eqNullSafe(F.col("_wk")) & (F.col("island") == F.col("_wi")))
    return out.select(F.col("_k").alias(key), "island", F.col("_i").alias(id_), "col", "cols")
