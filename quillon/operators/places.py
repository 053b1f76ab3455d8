"""Names of places: what rooms a name stands for, by its form alone or against a file of rooms.

A name is read as a stem and a tail: the tail is its last word, or several joined by hyphens or slashes. The parts of the
tail, by their kind, name a series: two ends to count between, letters, words, or a list. A reading is a kind and its rooms.
With a file of rooms all readings of a name are made at once, each with its rank; a join finds which exist, and the
existing one of the lowest rank is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import ORDINALS

SPAN = 20  # rooms that a series may hold beyond its first
#: Roman numbers, and words for floors.
ROMAN = tuple("I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split())
FLOORS = ("ground", *ORDINALS)


def _counted(low: Column, high: Column, label) -> Column:
    """Labels of the numbers from low to high where they rise and are no more than SPAN apart."""
    return F.when((low < high) & (high - low <= SPAN), F.transform(F.sequence(low, F.least(high, low + SPAN)), label))


def _in_order(parts: Column) -> Column:
    return F.when((F.size(parts) > 1) & (F.array_sort(F.array_distinct(parts)) == parts), parts)


def readings(name: Column) -> dict[str, Column]:
    """The labels that each kind of series gives, null where the name has another form, in the order they are preferred."""
    form = r"^(?:(.*[^\s/-])\s+)?([A-Za-z0-9]+(?:\s*[-/]\s*[A-Za-z0-9]+)*)$"
    stem, tail = F.regexp_extract(name, form, 1), F.regexp_replace(F.regexp_extract(name, form, 2), r"\s+", "")
    parts = F.split(tail, "[-/]")
    whole = lambda x: F.when(stem != "", F.concat(stem, F.lit(" "), x)).otherwise(x)
    all_like = lambda pattern: F.forall(parts, lambda x: x.rlike(pattern))
    hyphens, slashes, named = tail.contains("-") & ~tail.contains("/"), tail.contains("/") & ~tail.contains("-"), stem != ""
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    two = hyphens & (F.size(parts) == 2)
    mark, low, high = F.regexp_extract(a, "^([A-Za-z]?)", 1), F.regexp_extract(a, "([0-9]+)$", 1), F.regexp_extract(b, "([0-9]+)$", 1)
    alike = (F.length(low) == F.length(high)) & (mark == F.regexp_extract(b, "^([A-Za-z]?)", 1))
    padded = lambda n: F.concat(mark, F.lpad(n.cast("string"), F.length(low), F.lit("0")))
    numbers = (low.try_cast("int"), high.try_cast("int"))
    roman = F.array(*[F.lit(r) for r in ROMAN])
    at = lambda x: F.array_position(roman, x).cast("int")
    letter = lambda x: F.char(x)
    split = lambda x: F.regexp_extract_all(x, F.lit("([A-Z])"), F.lit(1))
    between = F.when(F.ascii(a) < F.ascii(b), F.transform(F.sequence(F.ascii(a), F.greatest(F.ascii(a), F.ascii(b))), letter))
    room, wing = F.regexp_extract(tail, "^([0-9]+)([A-Z]{2,})$", 1), F.regexp_extract(tail, "^([0-9]+)([A-Z]{2,})$", 2)
    found = {
        "numbers": F.when(two & ~named & all_like("^[A-Za-z]?[0-9]+$") & alike, _counted(*numbers, padded)),
        "named numbers": F.when(two & named & all_like("^[0-9]+$"), _counted(*numbers, lambda n: n.cast("string"))),
        "letters": F.when(hyphens & named & all_like("^[A-Z]$") & ~(two & (at(a) > 0) & (at(b) > 0)), F.when(F.size(parts) == 2, between).otherwise(_in_order(parts))),
        "roman": F.when(two & named & (at(a) > 0) & (at(b) > 0), _counted(at(a), at(b), lambda n: F.element_at(roman, n))),
        "joined letters": F.when(named & tail.rlike("^[A-Z]{2,}$"), _in_order(split(tail))),
        "numbered letters": F.when(~named & (room != ""), F.transform(_in_order(split(wing)), lambda x: F.concat(room, x))),
        "choices": F.when(slashes & named & all_like("^[A-Z0-9]+$"), parts),
        "words": F.when(two & named & all_like("^[A-Z][a-z]+$"), parts),
    }
    return {kind: F.transform(labels, whole) for kind, labels in found.items()}


def read_place(name: Column) -> Column:
    """struct(rule, rooms) of the first kind of series that the name has the form of; `plain` with the name itself where
    there is none; null of null."""
    tries = [F.when(rooms.isNotNull(), F.struct(F.lit(kind).alias("rule"), rooms.alias("rooms"))) for kind, rooms in readings(name).items()]
    return F.when(name.isNotNull(), F.coalesce(*tries, F.struct(F.lit("plain").alias("rule"), F.array(name).alias("rooms"))))


def spellings(name: Column, hotel: Column) -> Column:
    """The name and what it may have been meant as: without a leading article, without a first word said twice, without
    the initials of its hotel in front. Array of struct(how, name), those that differ from the name only."""
    initials = F.array_join(F.transform(F.split(hotel, r"\s+"), lambda w: F.substring(w, 1, 1)), "")
    others = [
        ("no article", F.regexp_replace(name, r"^(?i:the)\s+", "")),
        ("said once", F.regexp_replace(name, r"^(\S+)\s+\1(?=\s|$)", "$1")),
        ("no initials", F.when(name.startswith(F.concat(initials, F.lit(" "))), F.substr(name, F.length(initials) + 2)).otherwise(name)),
    ]
    made = F.array(F.struct(F.lit("").alias("how"), name.alias("name")), *[F.struct(F.lit(how).alias("how"), x.alias("name")) for how, x in others])
    return F.filter(made, lambda x: (x["how"] == "") | (x["name"] != name))


def floor_number(name: Column) -> Column:
    """The number of a floor that the name says, 0 for the ground; null where it says none."""
    word = F.regexp_extract(F.lower(name), r"^(\w+) (?:floor|level)$", 1)
    number = F.regexp_extract(F.lower(name), r"^(?:(?:floor|level) )?(\d+)(?:st|nd|rd|th)?(?: (?:floor|level))?$", 1).try_cast("int")
    listed = F.array_position(F.array(*[F.lit(w) for w in FLOORS]), word).cast("int")
    return F.coalesce(F.when(listed > 0, listed - 1), F.when(F.lower(name).rlike("floor|level"), number))


def on_file(places: DataFrame, rooms: DataFrame, aliases: DataFrame, id_: str, hotel: str, name: str) -> DataFrame:
    """(id, rule, level, rooms): the rooms of the file that each place of a hotel means.

    rooms: (hotel, level, floor, room), one row a room; aliases: (hotel, alias, rooms). Ranks, the first that exists on
    exactly one level wins: the name as a room, an alias, series of the name and of its other spellings, the rooms whose
    names begin with it (two at least), a floor, the longest beginning of the name that is a room. Without any: `unplaced`;
    an empty name: `hotel`. Distinct names are read once; the joins are equalities on (hotel, room).
    """
    asked = places.select(F.col(hotel).alias("hotel"), F.trim(F.coalesce(F.col(name), F.lit(""))).alias("name")).distinct()
    said = asked.withColumn("s", F.explode(spellings(F.col("name"), F.col("hotel")))).select("hotel", "name", F.col("s.how").alias("how"), F.col("s.name").alias("said"))
    reading = lambda rank, rule, found: F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), found.alias("rooms"))
    series = [reading(3 + k, kind, found) for k, (kind, found) in enumerate(readings(F.col("said")).items())]
    later = F.when(F.col("how") == "", 0).otherwise(20)
    made = said.select("hotel", "name", later.alias("later"), "how", F.explode(F.array(reading(0, "room", F.array("said")), *series)).alias("r")).filter("r.rooms IS NOT NULL")
    made = made.select("hotel", "name", (F.col("r.rank") + F.col("later")).alias("rank"), F.concat_ws(", ", F.when(F.col("how") != "", F.col("how")), "r.rule").alias("rule"), "r.rooms")
    known = aliases.select("hotel", F.col("alias").alias("said"), "rooms")
    made = made.unionByName(said.join(known, ["hotel", "said"]).select("hotel", "name", (F.lit(1) + later).alias("rank"), F.concat_ws(", ", F.when(F.col("how") != "", F.col("how")), F.lit("alias")).alias("rule"), "rooms"))
    # Beginnings of room names, and of the asked names.
    starts = lambda words: F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    words = F.split("room", " ")
    groups = rooms.withColumn("said", F.explode(F.slice(starts(words), F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))))).filter("said <> room").groupBy("hotel", "said").agg(F.min("level").alias("x"), F.max("level").alias("y"), F.array_sort(F.collect_set("room")).alias("rooms")).filter("x = y AND size(rooms) > 1")
    made = made.unionByName(said.join(groups, ["hotel", "said"]).select("hotel", "name", (F.lit(12) + later).alias("rank"), F.concat_ws(", ", F.when(F.col("how") != "", F.col("how")), F.lit("partitions")).alias("rule"), "rooms"))
    floors = said.filter("how = ''").withColumn("floor", floor_number(F.col("said"))).join(rooms.select("hotel", "floor", "level").distinct(), ["hotel", "floor"]).select("hotel", "name", F.lit(50).alias("rank"), F.lit("floor").alias("rule"), "level", F.lit(None).cast("array<string>").alias("rooms"))
    tried = F.split("said", " ")
    notes = said.filter("how = ''").select("hotel", "name", F.posexplode(starts(tried)).alias("k", "room"), F.size(tried).alias("n")).filter("k + 1 < n").join(rooms.select("hotel", "room", "level"), ["hotel", "room"])
    notes = notes.select("hotel", "name", (F.lit(100) - F.col("k")).alias("rank"), F.lit("note").alias("rule"), "level", F.array("room").alias("rooms"))
    # A reading holds where all its rooms lie on one level.
    spread = made.select("hotel", "name", "rank", "rule", "rooms", F.explode("rooms").alias("room")).join(rooms.select("hotel", "room", "level").distinct(), ["hotel", "room"])
    held = spread.groupBy("hotel", "name", "rank", "rule", "rooms", "level").agg(F.count_distinct("room").alias("n")).filter("n = size(array_distinct(rooms))").select("hotel", "name", "rank", "rule", "level", "rooms")
    single = held.groupBy("hotel", "name", "rank", "rule", "rooms").agg(F.min("level").alias("x"), F.max("level").alias("y")).filter("x = y").select("hotel", "name", "rank", "rule", F.col("x").alias("level"), "rooms")
    best = single.unionByName(floors).unionByName(notes).groupBy("hotel", "name").agg(F.min_by(F.struct("rule", "level", "rooms"), F.struct("rank", "level")).alias("b"))
    out = places.select(F.col(id_).alias("id"), F.col(hotel).alias("hotel"), F.trim(F.coalesce(F.col(name), F.lit(""))).alias("name")).join(best, ["hotel", "name"], "left")
    rule = F.when(F.col("name") == "", "hotel").otherwise(F.coalesce("b.rule", F.lit("unplaced")))
    return out.select("id", rule.alias("rule"), F.when(F.col("name") != "", F.col("b.level")).alias("level"), F.when(F.col("name") != "", F.col("b.rooms")).alias("rooms"))


def tallies(read: DataFrame, hotel: DataFrame, id_: str = "id") -> DataFrame:
    """(hotel, rule, n) of what on_file() gave. hotel: (id, hotel)."""
    return read.join(hotel, id_).groupBy("hotel", "rule").agg(F.count("*").alias("n"))
