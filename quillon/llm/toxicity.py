r"""Toxicity by weak supervision.

Every text is read once, whole, by many voters: one for each group of words of the lexicon (insults, contempt, threats,
obscenities in four languages), and patterns (aimed at "you", in capitals, masked as "m0r0n", "st*pid", "i d i o t", dense,
dismissive, and some that speak for a clean text), and one that the training fold's labels teach: beginnings of words that
stand out in toxic texts, whatever the language, and words of the lexicon are no part of it. What a text says is a set of bits, its finding. A generative label model
with a hidden class explains the voters' firings by each voter's rate in either class, fitted by expectation-maximisation
over the counts of all distinct findings; labels of the training fold are one voter more, with an accuracy of its own, so
wrong labels are outvoted. Voters that still go together inside a class are correlated, and each one's evidence is divided
by what it shares (1 + the sum of its correlations) before the model is fitted again. The learned voter stands beside the model: where it fires,
a text is clean only if both it and the others are wrong, and its share of errors is counted from the training labels. A linear classifier (logistic
regression, ridge penalty) over words, groups and patterns is then trained on the posterior labels; it scores the texts.

A beginning stands out in a text if at least one word in STANDS_OUT begins so. It is learned if the texts it stands out in are
toxic so often that chance is ruled out (LEARN_EVIDENCE nats); a group of near copies (equal least hash of three words)
counts as one text. The voter fires if two words, and one in STANDS_OUT, begin with learned ones.

All counts cover all documents; a round of the label model is one pass over the table of distinct findings and sends some
hundred sums to the driver. The classifier is fitted on at most FIT_FINDINGS distinct findings, the most frequent first, each
weighted by its count.

Defined cases: null and empty texts have no finding and score like any text without one; very long texts are read whole; equal
texts score alike, repeated rows and ids are rows of their own; a null doc_id is kept, has no label and is in the fold of the
empty string; labels that repeat an id count as toxic if one of them does, null ids and labels are skipped; without labels the
label voter is silent and the fit starts from fixed rates; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, blocks, forget, shingle_sets, text_arrays, tidy, written

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Distinct findings that the classifier is fitted on, at most.
FIT_FINDINGS = 50_000
ROUNDS = 8
#: Correlations inside a class below this are taken for chance.
CORRELATED = 0.1
RIDGE = 0.1
#: Letters of a beginning; words of a text to one that begins so; evidence in nats, toxic texts and number of learned ones.
BEGINNINGS, STANDS_OUT, LEARN_EVIDENCE, LEARN_TEXTS, LEARN_MOST = range(3, 11), 75, 16, 5, 10_000
#: Words whose beginnings a worker remembers.
KNOWN_WORDS = 200_000

#: Words of each lexicon voter; doubtful words, which are common words elsewhere, have voters of their own.
LEXICON = {
    "mind": "idiot idiots moron morons imbecile cretin dimwit halfwit dunce simpleton numbskull",
    "dull": "stupid dumb brainless clueless dumbass mindless",
    "worth": "worthless useless pathetic pitiful incompetent",
    "waste": "trash garbage filth filthy dirtbag",
    "vermin": "scum scumbag vermin maggot maggots parasite",
    "loss": "loser losers disgrace failure",
    "joke": "clown clowns buffoon laughingstock",
    "disgust": "disgusting repulsive revolting nauseating sickening",
    "hatred": "despise loathe detest hateful",
    "obscene": "fuck fucking fucker shit shitty bullshit bitch bitches bastard asshole motherfucker cunt whore slut",
    "german": "dummkopf trottel vollidiot schwachkopf arschloch abschaum versager widerlich ekelhaft wertlos erbärmlich missgeburt hurensohn drecksack scheiße",
    "french": "imbécile crétin abruti connard connasse salaud salope minable dégoûtant ordure débile enculé merde",
    "spanish": "idiota imbécil estúpido estúpida escoria asqueroso asquerosa patético inútil perdedor payaso mierda cabrón pendejo puta",
    "mild": "fool crap damn jerk creep ugly lame",
    "violent": "kill murder strangle hurt die",
    "doubtful": "hell hate vile pig rat gross dense con nul dick ass tonto dumm",
}
WORDS = [w for group in LEXICON.values() for w in group.split()]
PLACE = {w: k for k, w in enumerate(WORDS)}
#: Words that are insults wherever they stand; aimed, masked, dense and shouted findings look at these.
PLAIN = frozenset(w for name, group in LEXICON.items() if name not in ("violent", "doubtful") for w in group.split())
PATTERNS = ["aimed", "shouted", "masked", "dismissed", "several", "dense", "exclaimed", "capitals", "thanked", "licensed", "learned"]
VOTERS = [*LEXICON, *PATTERNS]

LETTERS = re.compile(r"[^\W\d_]+")
SECOND = frozenset("you your youre yours u ur du dich dein dir tu toi ton vous eres usted vos".split())
DISMISSED = re.compile(r"\b(?:shut up|get lost|drop dead|go to hell|go away|halt die klappe|hau ab|ta gueule|ferme-la|cállate|vete al)\b")
THANKED = re.compile(r"\b(?:thanks|thank you|please|danke|bitte|merci|s'il vous|gracias|por favor)\b")
LICENSED = re.compile(r"\b(?:licensed under|copyright|all rights reserved|permission is hereby)\b")
#: Begins only where a word does and never goes back, so that its time is linear in the text.
MASKED = re.compile(r"(?<![\w@$!*])[^\W\d_]*+[@$!*0134578][\w@$!*]*+")
SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-_][^\W\d_]){3,}(?!\w)")
RUNS = re.compile(r"([^\W\d_])\1{2,}")
UNMASK = str.maketrans("@$!0134578", "asioieastb")
#: What a text must hold for the patterns above to be looked for: one word each, a sign, letters between single separators.
DISMISSED_WORDS = frozenset("shut lost dead hell away klappe hau gueule ferme cállate vete".split())
THANKED_WORDS = frozenset("thanks thank please danke bitte merci il gracias favor".split())
LICENSED_WORDS = frozenset("licensed copyright reserved hereby".split())
SIGN = re.compile(r"[@$!*0134578]")
SIGNED = re.compile(r"[\w@$!*]++")
APART = re.compile(r"[ .\-_][^\W\d_][ .\-_][^\W\d_][ .\-_]")


def masked_words(text: str):
    """The matches of MASKED, looked for around signs and digits only."""
    end = 0
    for m in SIGN.finditer(text):
        if m.start() >= end:
            a = m.start()
            while a > end and SIGNED.match(text[a - 1]):
                a -= 1
            if found := MASKED.match(text, a):
                yield found[0]
            end = SIGNED.match(text, a).end()


def unmasked(text: str) -> bool:
    """Whether a word of the lexicon stands in the text with signs or digits for letters, spaced out or drawn out."""
    for found in masked_words(text):
        word = found.rstrip("@$!*").translate(UNMASK)
        if "*" in word:
            shape = re.compile(re.escape(word).replace(r"\*", "."))
            if sum(c != "*" for c in word) >= 3 and any(len(w) == len(word) and shape.fullmatch(w) for w in PLAIN):
                return True
        elif word in PLAIN and len(word) > 3:
            return True
    if APART.search(text) and any(re.sub(r"[ .\-_]", "", m[0]) in PLAIN for m in SPACED.finditer(text)):
        return True
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = codes[1:] == codes[:-1]
    if not (same[1:] & same[:-1]).any():
        return False
    return any(RUNS.sub(r"\1" * n, w) in PLAIN for w in LETTERS.findall(text) if RUNS.search(w) for n in (1, 2)) if RUNS.search(text) else False


def maybe_capitals(text: str, low: str, words: int) -> bool:
    """False only if no more than half of the words can be in capitals: as many letters must differ from their small ones.
    Capitals without small ones lie above U+2000."""
    if len(text) != len(low):
        return True
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, low))
    return 2 * np.count_nonzero(a != b) > words or bool((a > 0x2000).any())


class Learned(dict):
    """Whether a word begins with a learned beginning, by word; no word of the lexicon does."""

    def __init__(self, beginnings):
        self.beginnings = frozenset(beginnings)
        self.lengths = sorted({len(b) for b in beginnings})

    def __missing__(self, word: str) -> bool:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = hit = word not in PLACE and any(word[:k] in self.beginnings for k in self.lengths)
        return hit


def finding(text: str | None, learned: Learned | None = None) -> bytes:
    """The bits of a text: words of the lexicon, then patterns."""
    bits = np.zeros(len(WORDS) + len(PATTERNS), np.uint8)
    if text:
        low = text.lower()
        words = LETTERS.findall(low)
        own = set(words)
        found = PLACE.keys() & own
        for w in found:
            bits[PLACE[w]] = 1
        plain = found & PLAIN
        at = len(WORDS)
        if plain:
            places = [k for k, w in enumerate(words) if w in plain]
            bits[at] = any(w in SECOND for k in places for w in words[max(0, k - 3) : k + 4])
            bits[at + 1] = any(w.isupper() and w.lower() in plain for w in LETTERS.findall(text))
            bits[at + 4] = len(plain) > 1
            bits[at + 5] = 50 * len(places) >= len(words)
        bits[at + 2] = unmasked(low)
        bits[at + 3] = not DISMISSED_WORDS.isdisjoint(own) and DISMISSED.search(low) is not None
        bits[at + 6] = "!!" in text or "?!" in text
        bits[at + 7] = len(words) >= 5 and maybe_capitals(text, low, len(words)) and sum(map(str.isupper, LETTERS.findall(text))) * 2 > len(words)
        bits[at + 8] = not THANKED_WORDS.isdisjoint(own) and THANKED.search(low) is not None
        bits[at + 9] = not LICENSED_WORDS.isdisjoint(own) and LICENSED.search(low) is not None
        if learned is not None:
            hits = sum(map(learned.__getitem__, words))
            bits[at + 10] = hits >= 2 and hits * STANDS_OUT >= len(words)
    return np.packbits(bits).tobytes()


def unpacked(keys: pa.Array) -> np.ndarray:
    size = -(-(len(WORDS) + len(PATTERNS)) // 8)
    flat = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, size)
    return np.unpackbits(flat, axis=1, count=len(WORDS) + len(PATTERNS))


def _member() -> np.ndarray:
    out, at = np.zeros((len(WORDS), len(LEXICON)), np.int32), 0
    for k, group in enumerate(LEXICON.values()):
        n = len(group.split())
        out[at : at + n, k] = 1
        at += n
    return out


MEMBER = _member()


def votes(bits: np.ndarray) -> np.ndarray:
    """A column a voter: whether it fires."""
    return np.concatenate([(bits[:, : len(WORDS)] @ MEMBER > 0).astype(np.float64), bits[:, len(WORDS) :].astype(np.float64)], axis=1)


def features(bits: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(bits), 1)), votes(bits), bits[:, : len(WORDS)].astype(np.float64)], axis=1)


#: Its texts seldom hold words of the lexicon, so silences of the others must not speak against it: it stands beside the model.
TAUGHT = VOTERS.index("learned")
CLEAN = np.array([name in ("thanked", "licensed") for name in VOTERS])
#: For the posterior labels, a lexicon voter that is silent speaks for a clean text at half its weight (silences go together
#: more than firings do), and a silent pattern abstains. The fit itself takes silences for what they are.
QUIET = np.array([0.5 * (name in LEXICON) for name in VOTERS])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class LabelModel:
    """Share of toxic texts; each voter's rate of firing in clean and in toxic texts; the label voter's rates; each voter's
    weight, one over what it shares with correlated ones; the correlations inside the classes."""

    share: float
    rates: np.ndarray
    label_rates: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    taught: float = 0.0  # share of toxic texts among the labelled ones that the learned voter fires on

    def posterior(self, v: np.ndarray, label: np.ndarray, quiet: np.ndarray | float = 1.0) -> np.ndarray:
        """Probability of being toxic, given the votes and labels; `quiet` is what a silence counts."""
        on = np.log(self.rates[1] / self.rates[0]) * self.weights
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weights * quiet
        on[TAUGHT] = off[TAUGHT] = 0
        said = np.stack([np.log((1 - self.label_rates[1]) / (1 - self.label_rates[0])) * np.ones(len(v)), np.log(self.label_rates[1] / self.label_rates[0]) * np.ones(len(v))])
        p = _sigmoid(np.log(self.share / (1 - self.share)) + v @ on + (1 - v) @ off + np.where(label < 0, 0.0, np.where(label > 0, said[1], said[0])))
        return 1 - (1 - p) * (1 - self.taught * v[:, TAUGHT])

    def accuracies(self) -> dict[str, float]:
        """Share of toxic texts among those a voter fires on."""
        a, b = self.rates[1] * self.share, self.rates[0] * (1 - self.share)
        return dict(zip(VOTERS, (a / (a + b)).tolist(), strict=True))


def _summed(findings: DataFrame, f, size: int) -> np.ndarray:
    """Sum over all distinct findings of f(votes, label, count), an array of `size` numbers a batch."""

    def part(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(votes(unpacked(batch.column("finding"))), np.asarray(batch.column("label")), np.asarray(batch.column("n"), np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    out = np.zeros(size)
    for row in findings.mapInArrow(tidy(part), "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect():
        out[row[0]] = row[1]
    return out


def fit_labels(findings: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """The label model of a table (finding, label, n) of all distinct findings; label -1 is none."""
    m = len(VOTERS)

    def by_label(v, label, n):
        return np.concatenate([np.concatenate([[(n * (label == c)).sum()], (n * (label == c)) @ v]) for c in (0, 1)])

    sums = _summed(findings, by_label, 2 * (m + 1)).reshape(2, m + 1)
    start = np.stack([np.where(CLEAN, 0.1, 0.01), np.where(CLEAN, 0.05, 0.3)])
    rates = (sums[:, 1:] + 2 * start) / (sums[:, :1] + 2)
    share = (sums[1, 0] + 0.1) / (sums[:, 0].sum() + 2)
    fired = sums[:, 1 + TAUGHT]
    model = LabelModel(share, rates, np.array([0.05, 0.9]), np.ones(m))

    def round_of(model, rounds):
        for _ in range(rounds):

            def expected(v, label, n, model=model):
                p = model.posterior(v, label)
                out = []
                for c in (n * (1 - p), n * p):
                    out += [c.sum(), (c * (label >= 0)).sum(), (c * (label > 0)).sum(), *(c @ v)]
                return np.array(out)

            s = _summed(findings, expected, 2 * (m + 3)).reshape(2, m + 3)
            share = (s[1, 0] + 0.5) / (s[:, 0].sum() + 10)
            rates = np.clip((s[:, 3:] + 2 * start) / (s[:, :1] + 2), 1e-6, 1 - 1e-6)
            rates[1] = np.where(CLEAN, rates[1], np.maximum(rates[1], rates[0]))  # a voter for toxic texts never speaks for a clean one
            model = LabelModel(share, rates, (s[:, 2] + np.array([0.1, 1.8])) / (s[:, 1] + 2), model.weights, model.correlations)
        return model

    model = round_of(model, rounds)

    def pairs(v, label, n):
        p = model.posterior(v, label)
        return np.concatenate([np.concatenate([[c.sum()], c @ v, ((v * c[:, None]).T @ v).ravel()]) for c in (n * (1 - p), n * p)])

    size = 1 + m + m * m
    within, spread = np.zeros((m, m)), np.zeros(m)
    for s in _summed(findings, pairs, 2 * size).reshape(2, size):
        mean, both = s[1 : m + 1] / max(s[0], 1e-9), s[m + 1 :].reshape(m, m)
        within += both - s[0] * np.outer(mean, mean)
        spread += s[0] * mean * (1 - mean)
    r = within / np.sqrt(np.outer(spread, spread) + 1e-9)
    np.fill_diagonal(r, 0)
    r[r < CORRELATED] = 0
    model.correlations, model.weights = r, 1 / (1 + r.sum(axis=1))
    model = round_of(model, rounds)
    model.taught = fired[1] / (fired.sum() + 1)
    return model


def fit_classifier(findings: DataFrame, model: LabelModel, most: int = FIT_FINDINGS) -> np.ndarray:
    """Weights of the linear classifier, by Newton's method; every finding counts as toxic and as clean by its posterior."""
    table = findings.groupBy("finding").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "finding").limit(most).toArrow()
    bits = unpacked(table.column("finding"))
    if not len(bits):
        return np.zeros(1 + len(VOTERS) + len(WORDS))
    n, x = np.asarray(table.column("n"), np.float64), features(bits)
    p = model.posterior(votes(bits), np.full(len(bits), -1), QUIET)
    free = np.concatenate([[True], CLEAN, np.zeros(len(WORDS), bool)])  # all other weights are at least 0
    own = x.any(axis=0)
    while True:
        beta = np.zeros(x.shape[1])
        beta[own] = _newton(x[:, own], n, p)
        low = own & ~free & (beta < 0)
        if not low.any():
            return beta
        own &= ~low


def _newton(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    penalty, beta = np.full(x.shape[1], RIDGE), np.zeros(x.shape[1])
    penalty[0] = 1e-6
    for _ in range(25):
        q = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (n * q * (1 - q) + 1e-12)[:, None]).T @ x + np.diag(penalty), x.T @ (n * (p - q)) - penalty * beta)
        beta = beta + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def standing_out(text: str) -> list[str]:
    """The longest beginnings that stand out in a text, words of the lexicon left out; what begins one stands out as well.
    No word has two of them, so a text has STANDS_OUT at most."""
    words = LETTERS.findall(text.lower())
    own = [(w, n) for w, n in Counter(words).items() if len(w) >= BEGINNINGS[0] and w not in PLACE]
    longest: set[str] = set()
    for k in BEGINNINGS:  # a longer one can stand out only in words whose shorter one does
        count: dict[str, int] = {}
        for w, n in own:
            count[w[:k]] = count.get(w[:k], 0) + n
        found = {b for b, n in count.items() if n * STANDS_OUT >= len(words)}
        longest -= {b[:-1] for b in found}
        longest |= found
        own = [(w, n) for w, n in own if len(w) > k and w[:k] in found]
        if not own:
            break
    return sorted(longest)


def learn(texts: DataFrame, labels: DataFrame | None = None) -> list[str]:
    """The learned beginnings of a table (text, given), best first; none of them begins another. With labels (doc_id, given),
    of a table (doc_id, text): they are joined to what is left of a text, a hash and its longest beginnings, not to texts."""
    key = "given" if labels is None else "doc_id"

    def begin(batches):
        for batch in batches:
            data, offs = text_arrays(batch.column(0))
            for i, j in blocks(offs):
                keys, edges = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], 3)
                sketch = np.append(keys, 0)[np.minimum(edges[:-1], len(keys))].astype(np.int64)
                sketch[edges[1:] == edges[:-1]] = -1
                own = batch.column(0).slice(i, j - i).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(sketch), batch.column(1).slice(i, j - i), pa.array([" ".join(standing_out(t or "")) for t in own], pa.string())], names=["sketch", key, "longest"])

    told = texts.select("text", key).mapInArrow(tidy(begin), f"sketch bigint, {key} {dict(texts.dtypes)[key]}, longest string")
    if labels is not None:
        told = told.join(labels, "doc_id")
    single = written(told.groupBy("sketch").agg(F.max(F.struct("given", "longest")).alias("x")).select("x.*"), "toxic-beginnings")
    counted, toxic = single.agg(F.count("*"), F.coalesce(F.sum("given"), F.lit(0))).first()
    base = (toxic + 0.5) / (counted + 1)
    share = F.col("t") / F.col("n")
    clean = F.when(F.col("t") < F.col("n"), (1 - share) * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0)
    begins = F.transform(F.split("longest", " "), lambda w: F.transform(F.sequence(F.lit(BEGINNINGS[0]), F.length(w)), lambda k: F.substring(w, F.lit(1), k)))
    each = single.filter("longest != ''").select("given", F.explode(F.array_distinct(F.flatten(begins))).alias("b"))
    seen = each.groupBy("b").agg(F.sum("given").alias("t"), F.count("*").alias("n"))
    sure = seen.filter(F.col("t") >= LEARN_TEXTS).withColumn("e", F.col("n") * (share * F.log(share / F.lit(base)) + clean))
    sure = sure.filter((2 * F.col("t") > F.col("n")) & (share > base) & (F.col("e") >= LEARN_EVIDENCE))
    out: list[str] = []
    taken, within = set(), set()  # the chosen, and whatever begins one of them
    for row in sure.orderBy(F.desc("e"), F.desc(F.length("b")), "b").limit(LEARN_MOST).collect():
        b = row["b"]
        if b not in within and not any(b[:k] in taken for k in range(1, len(b))):
            out.append(b)
            taken.add(b)
            within.update(b[:k] for k in range(1, len(b) + 1))
    forget(single)
    return out


def folds(doc_id: str):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def score(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def find(batches):
        learned = Learned(beginnings) if beginnings else None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary_column([finding(t, learned) for t in part.column(2).to_pylist()])], names=["doc_id", "held_out", "finding"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), folds(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    given = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col(toxic) > 0).cast("int")).alias("given"))
    # Labels of the held-out fold are dropped before anything is counted.
    beginnings = learn(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).select("doc_id", "text"), given)
    found = written(rows.mapInArrow(tidy(find), f"doc_id {kind}, held_out boolean, finding binary"), "toxic-findings")
    labelled = found.join(given, "doc_id", "left").select("finding", F.when(F.col("held_out"), -1).otherwise(F.coalesce("given", F.lit(-1))).alias("label"))
    findings = written(labelled.groupBy("finding", "label").agg(F.count("*").alias("n")), "toxic-counts")
    beta = fit_classifier(findings, fit_labels(findings))
    forget(findings)

    def judge(batches):
        for batch in batches:
            s = _sigmoid(features(unpacked(batch.column(2))) @ beta) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return found.mapInArrow(tidy(judge), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op12(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
