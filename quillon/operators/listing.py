"""Rows of a listing: projections, predicates, checks and counts of its fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed
from ..functions.time import con_day


def wanted(choices: dict[str, tuple[Column, object]]) -> Column:
    """The conjunction of a reader's choices; `All` and None choose nothing. A list is met by any of its values, an array
    column by holding one of them."""

    def one(column: Column, value: object, many: bool) -> Column:
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        return F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])) if many else column.isin(values)

    made = [one(column, value, name.endswith("[]")) for name, (column, value) in choices.items() if value not in (None, "All")]
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), made, F.lit(True))


def getting_in(cost: Column, signup: Column, sold_out: Column) -> Column:
    """What a reader has to do: nothing, pay, sign up, or both; `full` where it is sold out; null where nothing is stated."""
    stated = cost.isNotNull() | signup.isNotNull() | sold_out.isNotNull()
    pays, signs = F.coalesce(cost > 0, F.lit(False)), F.coalesce(signup, F.lit(False))
    return F.when(F.coalesce(sold_out, F.lit(False)), "full").when(pays & signs, "pay and sign up").when(pays, "pay").when(signs, "sign up").when(stated, "nothing")


def is_cancelled(title: Column, text: Column) -> Column:
    """Whether a title begins or ends with the word, or a text begins with it."""
    return F.coalesce(title.rlike(r"(?i)^\W*cancell?ed\b|\bcancell?ed\W*$") | text.rlike(r"(?i)^\W*(?:this (?:event|panel) (?:is|has been) )?cancell?ed\b"), F.lit(False))


def noise(tracks: Column, quiet: list[str]) -> Column:
    """Whether every track of a row is a quiet one; a row without tracks is none."""
    return (F.size(tracks) > 0) & F.forall(tracks, lambda t: t.isin(quiet))


def soon(start: Column, end: Column, now: Column, minutes: int = 60) -> Column:
    return (end > now) & (start <= now + F.expr(f"INTERVAL {minutes} MINUTES"))


def well_formed(key: Column, kind: Column) -> Column:
    """Whether a followed key has the shape of its kind: an id of letters, digits and hyphens, or `axis:value`."""
    return F.coalesce(F.when(kind == "axis", key.rlike(r"^[a-z]+:[a-z0-9-]+$")).otherwise(key.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")), F.lit(False))


def room_words(hotel: Column, room: Column, bare: list[str]) -> Column:
    """A place in words: hotel and room; the room alone in hotels that need no name, the hotel alone without a room."""
    return F.when(room.isNull() | (room == ""), hotel).when(hotel.isin(bare), room).otherwise(F.concat(hotel, F.lit(" · "), room))


def derived(rows: DataFrame, start: str, room: str, people: str) -> DataFrame:
    """The rows with their con day, the room without what stands in brackets, and the people as one text."""
    return rows.withColumns({"con_day": con_day(F.col(start)), "clean_room": collapsed(F.regexp_replace(room, r"\([^)]*\)", " ")), "people_text": F.array_join(F.col(people), ", ")})


def tagger_input(title: Column, kind: Column, tracks: Column, text: Column, cap: int = 2000) -> Column:
    """What a labeller is asked about: cleaned title, kind, tracks, and the text without tags, capped."""
    return F.struct(collapsed(title).alias("title"), kind.alias("kind"), tracks.alias("tracks"), F.left(collapsed(F.regexp_replace(text, "<[^>]*>", " ")), F.lit(cap)).alias("text"))


def closed_values(answers: DataFrame, field: str, allowed: list[str]) -> DataFrame:
    """(value, n, ok): values of a field with their numbers, and whether the closed list has them."""
    return answers.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).withColumn("ok", F.coalesce(F.col("value").isin(allowed), F.lit(False)))


#: The signs of Windows-1252 for the bytes that are control characters in Latin 1, and these characters.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS = "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))


def repaired(s: Column) -> Column:
    """Text whose UTF-8 was read as Windows-1252, read again; others, and what that cannot have made, as they are."""
    plain = F.translate(s, WINDOWS, CONTROLS)
    again = F.encode(F.regexp_replace(plain, "[^\u0000-ÿ]", "?"), "ISO-8859-1").cast("string")
    broken = s.rlike("[Â-ô]") & ~s.rlike("[\u0080-\u009f]") & ~plain.rlike("[^\u0000-ÿ]") & F.is_valid_utf8(again)
    return F.when(broken, again).otherwise(s)


def log_faults(log: DataFrame, ids: DataFrame, order: str, id_: str, stamp: str, run: str) -> DataFrame:
    """(fault, n): lines of a change log with an unknown id, or with a stamp after their run."""
    known = ids.select(id_).distinct().withColumn("_k", F.lit(True))
    told = F.filter(F.array(F.when(F.col("_k").isNull(), "unknown id"), F.when(F.col(stamp) > F.col(run), "stamp after run")), lambda x: x.isNotNull())
    return log.join(known, id_, "left").select(order, F.explode(told).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def same_build(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(same): whether two builds hold the same rows, as often as each other, in any order."""
    line = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    one = a.select(line.alias("h"), F.lit(1).alias("d")).unionByName(b.select(line.alias("h"), F.lit(-1).alias("d")))
    return one.groupBy("h").agg(F.sum("d").alias("d")).agg(F.coalesce(F.bool_and(F.col("d") == 0), F.lit(True)).alias("same"))


def json_array_in(s: Column) -> Column:
    """What stands between the first bracket and the last, the array in a model's answer; null without."""
    found = F.regexp_extract(s, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def strings_in(s: Column) -> Column:
    """All string values of a JSON text, at any depth, in order."""
    return F.regexp_extract_all(F.regexp_replace(s, r'"(?:[^"\\]|\\.)*+"\s*:', ":"), F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1))


def nearest_rect(points: DataFrame, rects: DataFrame, plate: str, point: str, x: str, y: str, reach: float) -> DataFrame:
    """(point, rect, distance): the rectangle of a plate nearest to a point, the larger id among equals; none beyond reach.
    rects: (plate, rect, x0, y0, x1, y1).

    Both meet in the cells of a grid as wide as the reach: a rectangle stands in every cell it comes within reach of, a point in
    its own, so each pair that counts meets once and no point meets what is far off. Of equal rectangles the largest id stands
    for all, and equal points are met once.
    """
    cell = lambda v: F.floor(v / reach).cast("long")
    shapes = rects.groupBy(plate, "x0", "y0", "x1", "y1").agg(F.max("rect").alias("rect"))
    spread = shapes.withColumn("_cx", F.explode(F.sequence(cell(F.col("x0") - reach), cell(F.col("x1") + reach)))).withColumn("_cy", F.explode(F.sequence(cell(F.col("y0") - reach), cell(F.col("y1") + reach))))
    places = points.select(plate, x, y).distinct()
    both = places.withColumns({"_cx": cell(F.col(x)), "_cy": cell(F.col(y))}).join(spread, [plate, "_cx", "_cy"])
    dx = F.greatest(F.col("x0") - F.col(x), F.lit(0.0), F.col(x) - F.col("x1"))
    dy = F.greatest(F.col("y0") - F.col(y), F.lit(0.0), F.col(y) - F.col("y1"))
    d = F.round(F.sqrt(dx * dx + dy * dy), 9)
    near = both.select(plate, x, y, "rect", d.alias("distance")).filter(F.col("distance") <= reach)
    best = near.groupBy(plate, x, y).agg(F.min_by(F.struct("rect", "distance"), F.struct("distance", -F.col("rect"))).alias("b"))
    each = points.select(plate, x, y, point).join(best, [plate, x, y])
    return each.groupBy(point).agg(F.min_by("b", F.struct("b.distance", -F.col("b.rect"))).alias("b")).select(point, "b.rect", "b.distance")


def fitted(width: Column, height: Column, frame_width: float, frame_height: float) -> Column:
    """The scale by which a box fits into a frame."""
    return F.least(F.lit(frame_width) / width, F.lit(frame_height) / height)
