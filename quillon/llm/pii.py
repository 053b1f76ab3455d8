"""Personal data: candidate generation, gradient-boosted scoring, calibrated selection, in DataFrame functions only.

Validated formats (e-mail, IPv4, card, phone with country code) are always redacted. High-recall generators propose
further, possibly overlapping spans: spelled-out e-mail addresses, telephone numbers without country code, card numbers
with other separators, IPv4 with spaced or bracketed dots, and long keys that may be secrets. Boosted trees score each by
its format and its context; thresholds calibrated per kind select; of overlapping selections the higher score stays, and
none replaces a validated span. The trees are trained here, on examples made by rule (EXAMPLES of them, a fixed bound) and
on two thirds of those labelled by hand (pii_examples); thresholds come from the rest of both, and figures() measures recall
and precision on the held-out third by hand alone, which no rule has made.

Positions: regexp_extract_all gives the matches and split the text between them, both by the same search, so running
lengths are code-point offsets. Patterns have possessive loops and start at the start of a run (or where the last match
ended), which finds what the plain patterns find, in time linear in the text and without deep recursion.

Defined cases: a null or empty text has no spans; null doc_ids are carried; repeated rows give repeated results; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import written
from .pii_examples import HELD_OUT, LABELLED

KINDS = ("email", "ip", "card", "phone")
#: The kinds that candidates may have: all of them, and secrets, which have no validated format.
EVERY = (*KINDS, "secret")

#: The validated formats, in the form described above.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++[\x20]?(?:\(at\)|\[at\]|\{at\}|(?<=\x20)at(?=\x20)|@)[\x20]?[a-z0-9-]++(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|(?<=\x20)dot(?=\x20)|\.)[\x20]?[a-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[\x20]?(?:\.|\[\.\]|\(\.\))[\x20]?[0-9]{1,3}+){3}+(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.\-_/]{0,2}+[0-9]){12,18}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])",
    "phone": r"(?<![0-9+(.-])(?:00[\x20.-]?[0-9]{1,3}+[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20.\-/]{1,2}+[0-9]{2,4}+(?:[\x20.-][0-9]{2,4}+){1,4}+(?![0-9])",
}
BEFORE, AFTER = 32, 12
#: Words of the context, by what they point to.
CUES = {
    "email": "mail|e-mail|contact|write|courriel|correo|reach",
    "ip": "ip|host|server|address|client|login|addr",
    "card": "card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell|whatsapp|sms|number|anruf|llama",
    "secret": "token|secret|key|password|passwd|pwd|bearer|auth|credential",
    "not": "version|order|invoice|isbn|ref|id|section|page|date|sku|part|build|release|ticket",
}
EXAMPLES, ROUNDS, DEPTH = 4000, 12, 4
PRECISION = 0.97


_SPANS = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, hit: STRING>>)"
#: Matches whose offsets are summed at a time; blocks of them are summed before.
_BLOCK = 64


def _once(value: Column, then) -> Column:
    """then(value), the value computed once however often it is named: it is bound as the element of an array."""
    return F.transform(F.array(value), then)[0]


def _found(text: Column, pattern: str) -> Column:
    """Matches with their code-point offsets, in blocks: an array that grows match by match would be copied each time."""

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def with_gaps(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        return F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    def in_blocks(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))

    def placed(blocks: Column) -> Column:
        longs = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
        begins = F.aggregate(longs, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        each = F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.expr(_SPANS).alias("out")), step, lambda a: a["out"]))
        return F.flatten(each)

    none = F.expr(_SPANS)
    some = lambda hits: F.when(F.size(hits) > 0, _once(with_gaps(hits), lambda p: _once(in_blocks(p), placed))).otherwise(none)
    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(F.when(F.ascii(c) >= 53, (F.ascii(c) - 48) * 2 - 9).otherwise((F.ascii(c) - 48) * 2)))
    return (F.length(digits) > 0) & (F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _low_parts(hit: Column) -> Column:
    """Whether all four parts of dotted digits are at most 255."""
    return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")


VALID = {
    "email": lambda h: F.lit(True),
    "ip": _low_parts,
    "card": lambda h: luhn(_digits(h)),
    "phone": lambda h: F.length(_digits(h)).between(8, 15),
}


def _valid(kind: str):
    return lambda x: VALID[kind](x["hit"])


def _typed(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> dict[str, Column]:
    """Validated spans by kind: arrays of (start, end, hit)."""
    gates = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")}
    none = F.expr(_SPANS)
    return {k: F.coalesce(F.when(gates[k], F.filter(_found(text, BASE[k]), _valid(k))), none) for k in KINDS}


def candidates(text: Column) -> Column:
    """All proposals: (kind, start, end, hit, before, after)."""
    gates = {
        "email": text.rlike(r"(?i)@|[(\[{]at[)\]}]|\x20at\x20\S+\x20?(?:dot\x20|\.|[(\[{]dot)"),
        "ip": text.rlike(r"[0-9][\x20(\[]{0,2}+\.[\x20)\]]{0,2}+[0-9]{1,3}+[\x20(\[]{0,2}+\."),
        "card": text.rlike(r"[0-9](?:[\x20.\-_/]{0,2}+[0-9]){12}"),
        "phone": text.rlike(r"[0-9]{2}[)\x20.\-/]{1,2}[0-9]{2,4}+[\x20.-][0-9]{2}"),
        "secret": text.rlike(r"(?:^|[^A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20}"),
    }

    def full(kind: str) -> Column:
        spans = _found(text, WIDE[kind])
        return F.transform(
            F.filter(spans, lambda x: F.length(_digits(x["hit"])).between(7, 15)) if kind == "phone" else spans,
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"),
                F.substring(text, F.greatest(x["start"] - BEFORE + 1, F.lit(1)), F.least(x["start"], F.lit(BEFORE))).alias("before"), F.substring(text, x["end"] + 1, F.lit(AFTER)).alias("after"),
            ),
        )

    none = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT, hit: STRING, before: STRING, after: STRING>>)")
    return F.concat(*[F.coalesce(F.when(gates[k], full(k)), none) for k in EVERY])


def features(hit: Column, kind: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate as numbers."""
    digits = _digits(hit)
    out = {f"is_{k}": (kind == k) for k in EVERY}
    out |= {f"cue_{k}": before.rlike(rf"(?i)(?<![a-z])(?:{words})[^a-z]*(?:[a-z]+[^a-z]+)?$") for k, words in CUES.items()}
    out |= {
        "digits": F.length(digits), "length": F.length(hit), "letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), "luhn": luhn(digits),
        "separators": F.length(F.regexp_replace(hit, r"[^\x20.\-_/]", "")), "one_separator": hit.rlike(r"^[0-9]+([\x20.\-_/])[0-9]+(?:\1[0-9]+)*$"), "parenthesis": hit.contains("("),
        "spelled": hit.rlike(r"(?i)[(\[{\x20](?:at|dot)[)\]}\x20]"), "tld": hit.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$"), "low_parts": hit.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})[^0-9]*){4}$"),
        "shape_3_3_4": hit.rlike(r"^\(?[0-9]{3}\)?[\x20.\-/]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), "shape_date": hit.rlike(r"^(?:19|20)[0-9]{2}[\x20.\-/][0-9]|[.\-/](?:19|20)[0-9]{2}$"),
        "assigned": before.rlike(r"(?:[:=>]|(?i:bearer|key|token))\s*[\x22']?$"), "named_secret": before.rlike(rf"(?i)(?:{CUES['secret']})\S{{0,12}}\s{{0,2}}\S{{0,2}}\s{{0,2}}[\x22']?$"), "hex": hit.rlike("^[0-9a-f]{24,}$"),
        "mixed": hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]"), "parts": F.length(F.regexp_replace(hit, "[^-_/]", "")), "variety": F.size(F.array_distinct(F.split(hit, ""))) / F.length(hit),
        "groups_4": hit.rlike(r"^[0-9]{4}[^0-9]{1,2}[0-9]{4}[^0-9]{1,2}[0-9]{4}"), "glued_before": before.rlike(r"[A-Za-z0-9_$#=.,/-]$"), "glued_after": after.rlike(r"^[A-Za-z0-9_%$@=/]"), "plus": before.rlike(r"\+\s?[0-9]{0,3}[\x20.-]?$"),
    }
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Labelled candidates made by rule: (kind, hit, before, after, label)."""
    pick = lambda salt, many: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(many))
    number = lambda salt, width: F.lpad(pick(salt, 10**width).cast("string"), width, "0")
    word = lambda salt: F.element_at(F.array(*[F.lit(w) for w in ("anna", "kovri", "j.smith", "info", "sales7", "mika", "rowan", "t_lee")]), (pick(salt, 8) + 1).cast("int"))
    sep = lambda salt, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (pick(salt, len(of)) + 1).cast("int"))
    good = F.col("label") == 1
    mail = F.concat(word("w1"), sep("s1", " at ", " (at) ", "(at)", "[at]", " [at] "), word("w2"), sep("s2", " dot ", " (dot) ", "[dot]", "."), sep("s3", "com", "org", "net", "de"))
    not_mail = F.concat(word("w1"), F.lit(" at "), word("w2"), sep("s2", ". ", ".", " dot "), word("w3"))
    area = F.concat(F.lit("0"), number("a", 2))
    phone = F.when(pick("p", 6) == 0, F.concat(F.lit("("), number("a", 3), F.lit(") "), number("b", 3), F.lit("-"), number("c", 4)))
    phone = phone.when(pick("p", 6) == 1, F.concat(area, F.lit(" "), number("b", 4), F.lit(" "), number("c", 4))).when(pick("p", 6) == 2, F.concat_ws(" ", F.substring(area, 1, 2), *[number(k, 2) for k in ("d", "e", "f", "g")]))
    phone = phone.when(pick("p", 6) == 3, F.concat(F.lit("("), area, number("b", 1), F.lit(") "), number("c", 3), F.lit(" "), number("d", 2), F.lit(" "), number("e", 2))).when(pick("p", 6) == 4, F.concat(area, F.col("sep"), number("c", 4), F.lit(" "), number("d", 2), F.lit(" "), number("e", 2))).otherwise(F.concat(number("a", 3), F.col("sep"), number("b", 3), F.col("sep"), number("c", 4)))
    not_phone = F.when(pick("q", 6) == 0, F.concat(F.lit("20"), number("d", 2), F.lit("-"), number("e", 2), F.lit("-"), number("f", 2))).when(pick("q", 6) == 1, F.concat(number("d", 2), F.lit("."), number("e", 2), F.lit(".20"), number("f", 2)))
    not_phone = not_phone.when(pick("q", 6) == 2, F.concat(F.lit("20"), number("d", 2), F.lit("-"), number("e", 4), F.lit("-"), number("f", 2))).when(pick("q", 6) == 3, F.concat(number("d", 3), F.lit("-"), number("e", 3), F.lit(" "), number("f", 4))).otherwise(F.concat(number("a", 2), F.col("sep"), number("b", 3), F.col("sep"), number("c", 3)))
    body = F.concat(F.lit("4"), number("g", 14))
    check = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.when(luhn(F.concat(body, d.cast("string"))), d).otherwise(0)), F.lit(0), lambda a, v: a + v)
    mark = sep("h", ".", "/", "_", "  ")
    grouped = lambda x: F.concat(F.substring(x, 1, 4), mark, F.substring(x, 5, 4), mark, F.substring(x, 9, 4), mark, F.substring(x, 13, 4))
    card, not_card = grouped(F.concat(body, check.cast("string"))), F.when(pick("nc", 2) == 0, grouped(F.concat(body, F.pmod(check + 1 + pick("o", 9), F.lit(10)).cast("string")))).otherwise(F.concat(number("i", 5), F.lit("."), number("j", 8)))
    part = lambda salt: pick(salt, 256).cast("string")
    dot = sep("k", "[.]", " . ", "(.)")
    ip = F.concat(part("l"), dot, part("m"), dot, part("n"), dot, part("o2"))
    not_ip = F.concat((pick("l", 600) + 256).cast("string"), dot, part("m"), dot, part("n"), dot, (pick("r", 600) + 256).cast("string"))
    key = F.when(pick("hex", 2) == 0, F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)).otherwise(F.substring(F.regexp_replace(F.base64(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 512).cast("binary")), "[+/=]", ""), 5, 28))
    not_key = F.when(pick("nk", 3) == 0, F.substring(F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256), 1, 40)).when(pick("nk", 3) == 1, F.concat(word("w1"), F.lit("-"), number("i", 5), F.lit("-"), word("w2"), F.lit("-"), number("j", 8))).otherwise(F.concat(F.lit("IMG_"), number("d", 8), F.lit("_"), number("e", 9)))
    cue = lambda k: F.element_at(F.array(*[F.lit(w) for w in CUES[k].split("|")]), (pick("cue" + k, len(CUES[k].split("|"))) + 1).cast("int"))
    rows = spark.range(n).withColumns({"label": (pick("label", 2) == 0).cast("double"), "kind": F.element_at(F.array(*[F.lit(k) for k in EVERY]), (pick("kind", len(EVERY)) + 1).cast("int")), "sep": sep("t", "-", ".", " ")})
    hit, before = F.lit(""), F.lit("")
    for kind, yes, no in (("email", mail, not_mail), ("ip", ip, not_ip), ("card", card, not_card), ("phone", phone, not_phone), ("secret", key, not_key)):
        hit = F.when(F.col("kind") == kind, F.when(good, yes).otherwise(no)).otherwise(hit)
        before = F.when(F.col("kind") == kind, F.when(good & (pick("ctx", 4) > 0), F.concat(F.lit("so "), cue(kind), sep("u", ": ", " ", " is "))).otherwise(F.when(~good & (pick("ctx", 2) > 0), F.concat(cue("not"), sep("u", ": ", " ", " no. "))).otherwise(F.lit("and then the ")))).otherwise(before)
    # A key is a secret by what stands before it; a digest is none.
    before = F.when((F.col("kind") == "secret") & good, F.concat(cue("secret"), sep("u", " = ", ": ", "=", " "), sep("q", '"', "", "'"))).when((F.col("kind") == "secret") & (pick("nc2", 2) == 0), F.concat(sep("u2", "commit", "sha1", "file", "row"), F.lit(" "))).otherwise(before)
    return rows.select("kind", hit.alias("hit"), before.alias("before"), F.when(~good & (pick("v", 4) == 0), "7a kg").otherwise(" and").alias("after"), "label", pick("split", 4).alias("part"))


class Scorer:
    """Boosted trees and the threshold of each kind."""

    def __init__(self, model: GBTClassificationModel, names: list[str], thresholds: dict[str, float]):
        self.model, self.names, self.thresholds = model, names, thresholds

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows (kind, hit, before, after, ...) with `score` and whether it is `selected`."""
        columns = features(F.col("hit"), F.col("kind"), F.col("before"), F.col("after"))
        ready = VectorAssembler(inputCols=self.names, outputCol="_q_features").transform(rows.withColumns({n: columns[n[3:]] for n in self.names}))
        scored = self.model.transform(ready).withColumn("score", vector_to_array("probability")[1])
        limit = F.lit(2.0)
        for kind, at in self.thresholds.items():
            limit = F.when(F.col("kind") == kind, at).otherwise(limit)
        return scored.withColumn("selected", F.col("score") >= limit).select(*rows.columns, "score", "selected")


def train(spark: SparkSession, labelled: DataFrame | None = None, precision: float = PRECISION) -> Scorer:
    """Trees on three quarters of the examples; thresholds on the rest: the lowest with the wanted precision. labelled: (kind,
    hit, before, after, label, part), part 0 for what thresholds are calibrated on; else examples by rule and by hand, a row
    by hand in as many copies as make the two weigh alike."""
    if labelled is None:
        copies = max(1, EXAMPLES // (4 * len(LABELLED)))
        own = by_hand(spark).filter("part > 0").withColumn("part", F.col("part") - 1)
        labelled = examples(spark).unionByName(own.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c"))
    labelled = written(labelled, "pii-examples").coalesce(2)
    columns = features(F.col("hit"), F.col("kind"), F.col("before"), F.col("after"))
    names = [f"_q_{k}" for k in columns]
    ready = VectorAssembler(inputCols=names, outputCol="_q_features").transform(labelled.withColumns({f"_q_{k}": v for k, v in columns.items()}))
    model = GBTClassifier(featuresCol="_q_features", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(ready.filter("part > 0"))
    checked = model.transform(ready.filter("part = 0")).select("kind", F.floor(vector_to_array("probability")[1] * 50).alias("bin"), "label")
    bins = [r.asDict() for r in checked.groupBy("kind", "bin").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()]  # 50 bins a kind at most
    thresholds = {}
    for kind in EVERY:
        yes = n = 0
        at = 0.98
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            yes, n = yes + r["yes"], n + r["n"]
            if yes >= precision * n:
                at = r["bin"] / 50
        thresholds[kind] = max(at, 0.5)
    return Scorer(model, names, thresholds)


def by_hand(spark: SparkSession) -> DataFrame:
    """The examples labelled by hand; part 0 is held out."""
    rows = [(kind, hit, before, after, float(label), k % HELD_OUT) for k, (kind, before, hit, after, label) in enumerate(LABELLED)]
    return spark.createDataFrame(rows, "kind string, hit string, before string, after string, label double, part long")


def figures(spark: SparkSession, scorer: Scorer | None = None, held: bool = True) -> DataFrame:
    """(kind, n, recall, precision) on the examples labelled by hand, those held out or all, by find() over their whole texts:
    a candidate that no generator proposes is missed. A span of the kind that meets the labelled one has found it."""
    rows = by_hand(spark).filter("part = 0 OR NOT " + str(held).lower()).withColumn("id", F.monotonically_increasing_id())
    rows = written(rows.withColumn("text", F.concat("before", "hit", "after")), "pii-figures")
    met = lambda s: (s["kind"] == F.col("kind")) & (s["start"] < F.length("before") + F.length("hit")) & (s["end"] > F.length("before"))
    got = rows.join(find(rows, scorer, "id", "text").withColumnRenamed("doc_id", "id"), "id").withColumn("selected", F.exists(F.concat(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), "added"), met))
    right = F.count_if(F.col("selected") & (F.col("label") == 1))
    return got.groupBy("kind").agg(F.count("*").alias("n"), (right / F.count_if(F.col("label") == 1)).alias("recall"), (right / F.greatest(F.count_if("selected"), F.lit(1))).alias("precision"))


def _listed(spans: Column) -> Column:
    """kind:start:end in the order of EVERY, then of starts."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, scorer: Scorer | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and added (arrays of kind, start, end). One pass over the texts; candidates are few."""
    column = F.coalesce(F.col(text), F.lit(""))
    base = base_spans(column)
    typed = F.concat(*[F.transform(base[k], _typed(k)) for k in KINDS])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.lit(1)).alias("k1"), F.xxhash64(F.col(text), F.lit(2)).alias("k2"), typed.alias("base"), candidates(column).alias("wide"))
    free = F.filter("wide", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = written(rows.withColumn("wide", free), "pii-spans")
    scorer = scorer or train(docs.sparkSession)
    proposals = rows.filter(F.size("wide") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("wide").alias("c")).select("k1", "k2", "c.*")
    chosen = scorer.score(proposals).filter("selected").groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "end", "kind"))).alias("found"))
    # Higher scores first; one that overlaps a chosen span goes.
    apart = F.aggregate(
        "found", F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>)"),
        lambda a, s: F.when(F.exists(a, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), a).otherwise(F.concat(a, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))),
    )
    chosen = chosen.select("k1", "k2", apart.alias("added"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, start: INT, end: INT>>)")
    return rows.join(chosen, ["k1", "k2"], "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def redact(docs: DataFrame, scorer: Scorer | None = None, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """The documents with every span of the text replaced by its kind; matched by id and text, so keys may repeat."""
    marks = find(docs.withColumn("_q_key", F.struct(F.xxhash64(F.lit(3), F.col(text)), F.length(text))), scorer, "_q_key", text).dropDuplicates(["doc_id"])
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marks = marks.select(F.col("doc_id").alias("_q_marked"), spans.alias("_q_spans"))
    opening, closing = mask.split("{}")
    out = F.aggregate(
        "_q_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(opening), s["kind"], F.lit(closing)).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))),
    )
    keyed = docs.withColumn("_q_key", F.struct(F.xxhash64(F.lit(3), F.col(text)), F.length(text)))
    return keyed.join(marks, F.col("_q_key").eqNullSafe(F.col("_q_marked")), "left").withColumn(text, F.when(F.size("_q_spans") > 0, out).otherwise(F.col(text))).select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in EVERY]), s["kind"]).cast("int")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [F.size(F.filter("added", _is("secret"))).cast("long").alias("n_secret"), F.size(every).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), *more)
