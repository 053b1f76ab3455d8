"""Toxicity: what voters find, the label model on drawn votes, held-out labels, planted and odd texts."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

from quillon.llm import toxicity as tx  # noqa: E402

CALM = "the ferry leaves the quay at seven and the lamps along the strait burn low until the morning"


def fired(text):
    return {name for name, on in zip(tx.VOTERS, tx.votes(tx.unpacked(pa.array([tx.finding(text)], pa.binary())))[0]) if on}


@pytest.mark.parametrize(("text", "names"), [
    (None, set()), ("", set()), (CALM, set()), ("trashcan", set()), ("what a moron", {"mind", "dense"}), (CALM + " SCUM " + CALM + CALM + CALM + CALM, {"vermin", "shouted"}), ("you complete idiot", {"mind", "aimed", "dense"}), ("m0r0n st*pid", {"masked"}), ("such an i d i o t there", {"masked"}),
    ("stuuupid", {"masked"}), ("the &&& of$$$ to***", set()), ("shut up please", {"dismissed", "thanked"}), ("WHY ON EARTH WOULD THEY!!", {"exclaimed", "capitals"}), ("un crétin pathétique", {"french", "dense"}),
])
def test_findings(text, names):
    assert fired(text) == names


def plain_bits(text):
    """The word bits by a search for each word on its own."""
    return [re.search(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", (text or "").lower()) is not None for w in tx.WORDS]


def test_words_are_whole(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert tx.unpacked(pa.array([tx.finding(r.text)], pa.binary()))[0, : len(tx.WORDS)].tolist() == plain_bits(r.text)


def drawn(n=6000, seed=2):
    """Findings drawn from known rates: three independent voters, two that copy one of them, and noisy labels."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    bits = np.zeros((n, len(tx.WORDS) + len(tx.PATTERNS)), np.uint8)
    for word, (clean, toxic) in {"idiot": (0.01, 0.7), "stupid": (0.02, 0.6), "trash": (0.3, 0.35), "scum": (0.01, 0.5)}.items():
        bits[:, tx.PLACE[word]] = rng.random(n) < np.where(y, toxic, clean)
    bits[:, len(tx.WORDS) + tx.PATTERNS.index("aimed")] = bits[:, tx.PLACE["idiot"]]
    label = np.where(rng.random(n) < 0.3, (y ^ (rng.random(n) < 0.1)).astype(int), -1)
    return y, bits, label


def test_label_model(spark):
    y, bits, label = drawn()
    df = spark.createDataFrame([(bytearray(np.packbits(b).tobytes()), int(x)) for b, x in zip(bits, label)], "finding binary, label int").groupBy("finding", "label").agg(F.count("*").alias("n"))
    model = tx.fit_labels(df)
    at = tx.VOTERS.index
    assert model.share == pytest.approx(0.2, abs=0.03)
    assert model.rates[1, at("mind")] == pytest.approx(0.7, abs=0.13) and model.rates[0, at("mind")] == pytest.approx(0.01, abs=0.02)
    assert model.accuracies()["waste"] < 0.4 < 0.9 < model.accuracies()["mind"]
    assert model.correlations[at("mind"), at("aimed")] > 0.5 and model.correlations[at("mind"), at("vermin")] < 0.2
    assert model.weights[at("aimed")] < 0.6 and model.weights[at("dull")] > 0.8
    p = model.posterior(tx.votes(bits), label)
    assert ((p > 0.5) == y).mean() > 0.93


def test_held_out_labels(spark):
    """Over 1,000 documents: labels that the words bear out are found, nearly no clean document is taken."""
    folder = "/root/testdata/sf0.01"
    rows = tx.op12(spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    taken = [y for p, y in held if p]
    assert len(taken) >= 5 and np.mean(taken) >= 0.95
    assert np.mean([p == y for p, y in held]) > 0.93


@pytest.fixture(scope="module")
def table(spark):
    insults = ["you pathetic worthless idiot", "what disgusting trash you scum are", "a stupid clown and a loser, you moron", "stupid stupid trash"]
    rows = [(k, f"{CALM} {insults[k % 4]} {CALM}" if k % 5 == 0 else f"{CALM} number {k}") for k in range(200)]
    odd = [(1000, None), (1001, ""), (1002, "x" * 3_000_000 + " idiot"), (1003, rows[0][1]), (1003, rows[0][1]), (None, rows[5][1]), (1004, rows[1][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns({"finding": F.lit("x"), "held_out": F.lit(3), "n": F.lit(1), "label": F.lit(0), "given": F.lit(0)})
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(150)] + [(3, None), (None, 1), (7, 0)], "doc_id long, toxic int").withColumn("finding", F.lit(1))
    return docs, labels


def test_odd_rows(spark, table):
    got = [tuple(r) for r in tx.score(*table).collect()]
    assert len(got) == 207
    score = {}
    for i, _, s, p in got:
        assert 0 <= s <= 1 and p == (s >= 0.7)
        assert score.setdefault(i, s) == s  # equal texts of one id
    assert all((score[k] >= 0.7) == (k % 5 == 0) for k in range(200))
    assert score[1003] == score[0] and score[None] == score[5] and score[1004] == score[1] and score[1000] == score[1001] < 0.7
    assert next(h for i, h, *_ in got if i is None) == (zlib.crc32(b"") % 3 == 1)


def test_no_labels_and_no_rows(spark, table):
    docs, labels = table
    got = {r.doc_id: r.predicted for r in tx.score(docs, labels.filter("doc_id < 0")).collect()}
    assert all(got[k] == (k % 5 == 0) for k in range(200))
    assert tx.score(docs.filter("doc_id < 0"), labels).collect() == []


def test_held_out_labels_do_not_matter(spark, table):
    docs, labels = table
    turned = labels.withColumn("toxic", F.when(tx.folds("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, tx.score(docs, labels).collect()), key=repr) == sorted(map(tuple, tx.score(docs, turned).collect()), key=repr)


def test_words_outside_the_lexicon_are_learned(spark):
    """Beginnings that the training labels bear out are found in held-out texts; near copies of one text teach nothing."""
    rng = np.random.default_rng(5)
    parts = ["lo", "ma", "ten", "ri", "sou", "vel", "ka", "du", "pre", "no"]
    word = lambda: "".join(rng.choice(parts, 3))
    plain = lambda n=120: [word() for _ in range(n)]
    rows = []
    for k in range(600):
        words = plain()
        if k % 5 == 0:
            for at in rng.choice(120, 5, replace=False):
                words[at] = "Zarqu" + word()
        rows.append((k, " ".join(words)))
    copied = plain()
    for at in (3, 40, 80):
        copied[at] = "brimbo"
    rows += [(k, " ".join([*copied, str(k)])) for k in range(1000, 1060)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0 or k >= 1000)) for k, _ in rows], "doc_id long, toxic int")
    given = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("given"))
    assert [b[:4] for b in tx.learn(given)] == ["zarq"]
    got = tx.score(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got if r.doc_id < 1000) and any(r.held_out and r.predicted for r in got)


def test_short_ways_agree_with_the_patterns():
    rng = np.random.default_rng(6)
    for n in range(3000):
        text = "".join(rng.choice(list("abEÉ ß1@$!*_-. İℂ"), n % 40))
        low = text.lower()
        assert list(tx.masked_words(low)) == [m[0] for m in tx.MASKED.finditer(low)]
        assert tx.APART.search(low) or not tx.SPACED.search(low)
        words = tx.LETTERS.findall(text)
        assert tx.maybe_capitals(text, low, len(words)) or sum(map(str.isupper, words)) * 2 <= len(words)


def plain_beginnings(text):
    """All beginnings that stand out, each counted on its own."""
    words = tx.LETTERS.findall(text.lower())
    counts = Counter(w[:k] for w in words if w not in tx.PLACE for k in tx.BEGINNINGS if len(w) >= k)
    return {b for b, n in counts.items() if n * tx.STANDS_OUT >= len(words)}


def test_longest_beginnings_stand_for_all(spark, sf):
    odd = ["", "ab", "idiot", "abc abcd abcde", "İstanbul 𐐷𐐷𐐷𐐷 " * 3, "x" * 100_000, "abcdefghijklm " * 80 + "abcdefgxy " * 2 + "seldom " + CALM * 20]
    for text in odd + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]:
        longest = tx.standing_out(text)
        assert {b[:k] for b in longest for k in range(tx.BEGINNINGS[0], len(b) + 1)} == plain_beginnings(text)
        assert len(longest) <= tx.STANDS_OUT and not any(a != b and b.startswith(a) for a in longest for b in longest)


def test_no_text_is_shuffled(spark, table, monkeypatch):
    """Labels too many to be broadcast meet what was found in a text, not the text."""
    plans = []

    def noted(df, name):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return written(df, name)

    written = tx.written
    monkeypatch.setattr(tx, "written", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert tx.score(*table).count() == 207
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", "\n".join(plans))
    assert moved and not [columns for columns in moved if re.search(r"\btext#", columns)]
