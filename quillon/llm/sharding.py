"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Keys hash to a ring cut into `slices` equal arcs; every shard has `vnodes` points on it. A key belongs to the first point
clockwise; when that shard is full it goes on clockwise to the next shard with room. Capacity is (1 + slack) times the
even share, so balance is guaranteed, and a key moves only when its shard, or one before it on its way, fills up.

How it scales: rows are counted per slice (a partial aggregate, `slices` rows whatever the input). Slices are served in a
fixed hash order by one fold over those rows, which finds when each shard fills; as shards fill once, that is all there is
to know. A slice in which a shard fills is cut by a running sum inside the slice. No step holds rows of a whole shard.

Defined cases: a null text has size 1; a row with a null doc_id is placed by its text; rows with equal ids share a place on
the ring and may be cut apart only by capacity; an empty table gives an empty result; other columns pass through, columns
`shard` and `slot` of the input give way to the results, and the working columns begin with `_q_`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"
_NEVER = 9223372036854775807


def _ring(spark, shards: int, slices: int, vnodes: int) -> DataFrame:
    """Per slice the shards in the order in which they come clockwise. Its size is fixed by the parameters."""
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("vnode"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(slices)).alias("point"))
    nodes = points.groupBy("shard").agg(F.collect_set("point").alias("points"))
    ring = nodes.agg(F.array_sort(F.collect_list(F.struct("shard", "points"))).alias("nodes"))
    near = f"transform(array_sort(transform(nodes, g -> struct(array_min(transform(g.points, p -> pmod(p - id, {slices}L))) AS d, g.shard AS shard))), x -> x.shard)"
    return spark.range(slices).crossJoin(ring).select(F.col("id").alias("_q_slice"), F.expr(near).alias("_q_order"))  # the ring is one row


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", load: str = "rows", slack: float = 0.0, slices: int = 8192, vnodes: int = 128) -> DataFrame:
    """The documents with `shard` and `slot` (gapless from 0 within the shard), and `_q_size`.

    load: what is balanced, `rows` or `bytes`. slack: how far above the even share a shard may go; 0 gives counts at
    most one apart, more slack moves fewer keys when shards are added.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "_q_size")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    place = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit("text"), F.col(text))).otherwise(F.xxhash64(F.lit("key"), F.col(doc_id)))
    rows = docs.withColumns({"_q_size": size, "_q_place": place, "_q_slice": F.pmod(place, F.lit(slices))})
    weight = F.lit(1).cast("long") if load == "rows" else F.col("_q_size")
    counts = rows.groupBy("_q_slice").agg(F.sum(weight).alias("_q_load"))
    ring = _ring(spark, shards, slices, vnodes)
    slots = counts.join(F.broadcast(ring), "_q_slice").withColumn("_q_turn", F.xxhash64(F.lit("turn"), F.col("_q_slice")))
    state = slots.agg(F.array_sort(F.collect_list(F.struct("_q_turn", "_q_slice", "_q_load", "_q_order"))).alias("served"), F.sum("_q_load").alias("total"))
    if slack > 0:
        room = f"CAST(ceil(total * {1 + slack}D / {shards}) AS BIGINT)"
    else:
        room = f"CAST(floor(total / {shards}) AS BIGINT) + IF(i < total % {shards}, 1L, 0L)"
    state = state.withColumn("caps", F.expr(f"transform(sequence(0, {shards - 1}), i -> {room})"))
    step = f"""aggregate(e._q_order, named_struct('left', e._q_load, 'used', s.used, 'full', s.full, 'part', s.part), (a, k) ->
        IF(a.left = 0L OR a.full[k] < {_NEVER}L, a, named_struct(
            'left', a.left - least(a.left, caps[k] - a.used[k]),
            'used', transform(a.used, (v, i) -> IF(i = k, v + least(a.left, caps[k] - a.used[k]), v)),
            'full', transform(a.full, (v, i) -> IF(i = k AND a.left >= caps[k] - a.used[k], e._q_turn_no, v)),
            'part', transform(a.part, (v, i) -> IF(i = k AND a.left >= caps[k] - a.used[k], caps[k] - a.used[k], v)))),
        a -> named_struct('used', a.used, 'full', a.full, 'part', a.part))"""
    state = state.withColumn("served", F.expr("transform(served, (e, i) -> named_struct('_q_slice', e._q_slice, '_q_load', e._q_load, '_q_order', e._q_order, '_q_turn_no', CAST(i AS BIGINT)))"))
    start = f"named_struct('used', transform(caps, c -> 0L), 'full', transform(caps, c -> IF(c <= 0L, -1L, {_NEVER}L)), 'part', transform(caps, c -> 0L))"
    state = state.withColumn("ends", F.expr(f"aggregate(served, {start}, (s, e) -> {step})"))
    # Where a slice's running load passes from shard to shard: (from, shard), the first from 0.
    parts = """filter(aggregate(e._q_order, named_struct('at', 0L, 'open', true, 'out', CAST(array() AS ARRAY<STRUCT<at: BIGINT, shard: INT>>)), (a, k) ->
        IF(NOT a.open OR ends.full[k] < e._q_turn_no, a,
           named_struct('at', a.at + IF(ends.full[k] = e._q_turn_no, ends.part[k], 0L), 'open', ends.full[k] = e._q_turn_no,
                        'out', concat(a.out, array(named_struct('at', a.at, 'shard', k))))), a -> a.out), x -> x.at < e._q_load OR x.at = 0L)"""
    cuts = state.selectExpr("inline(transform(served, e -> named_struct('_q_slice', e._q_slice, '_q_turn_no', e._q_turn_no, '_q_parts', " + parts + ")))")
    in_slice = Window.partitionBy("_q_slice").orderBy("_q_place", F.col(doc_id), F.xxhash64(F.col(text)))
    before = F.row_number().over(in_slice) - 1 if load == "rows" else F.sum(weight).over(in_slice.rowsBetween(Window.unboundedPreceding, 0)) - weight
    placed = rows.withColumns({"_q_before": before.cast("long"), "_q_row": F.row_number().over(in_slice)})
    placed = placed.join(F.broadcast(cuts), "_q_slice")  # `slices` rows at most
    placed = placed.withColumn("shard", F.expr("element_at(filter(_q_parts, x -> x.at <= _q_before), -1).shard"))
    # Places in a shard: rows of earlier slices, then the rows before this one in the slice.
    filled = placed.groupBy("shard", "_q_turn_no").agg(F.count("*").alias("_q_n"), F.min("_q_row").alias("_q_first"))
    ahead = F.coalesce(F.sum("_q_n").over(Window.partitionBy("shard").orderBy("_q_turn_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = filled.withColumn("_q_ahead", ahead).select(F.col("shard").alias("_q_s"), F.col("_q_turn_no").alias("_q_t"), "_q_ahead", "_q_first")
    placed = placed.join(F.broadcast(bases), (F.col("shard") == F.col("_q_s")) & (F.col("_q_turn_no") == F.col("_q_t")))  # a row or two a slice
    return placed.withColumn("slot", F.col("_q_ahead") + F.col("_q_row") - F.col("_q_first")).select(*docs.columns, "shard", "slot", "_q_size")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    narrow = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")).alias("_t"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    done = shard(narrow, text="_t")
    return done.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
