"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed into phrases, each the longest
match that starts there and occurs in the language's sample; the language that needs the fewest phrases, times the bits
that name a place in its sample, wins (ties: the first by name). The score is 1 - bits of the best / bits of the second.

Whole texts are parsed. All pieces of PIECE bytes of a slice go in step, one transition of every piece by one numpy gather,
each as if a phrase began with it; then the pieces behind a text's first are run again from the state that the piece before
ends in, until both runs are in the same state, from where on they agree. What the parse counts is that of the whole text.

The automata are built once, in the driver, from the sample, whose size is bounded by the parameters, and broadcast.

Defined cases: null text, or no letter: `und`, score 0; null or unlabelled rows teach nothing; no learned language: `und`
for all; a single learned language gives score 1; equal texts get equal results; other columns do not matter, and columns
of the results' names give way to the results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import text_arrays, tidy

UND = "und"
#: Bounds of the fitted sample: rows a language, characters a passage (cut at white space where there is any), bytes a language.
SAMPLE_ROWS, PASSAGE, SAMPLE_BYTES = 96, 512, 32_768
#: Parts of a language's rows that are ranked before the language is.
SPLIT = 64
PIECE, SLICE = 1024, 2 << 20
#: Rounds in which pieces are run again together; chains of pieces that go on changing after that are run one by one.
ROUNDS = 4

#: A-Z are lower-cased; other ASCII but letters counts as space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def fold(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A to Z, À to Þ) with one space between words, and new offsets."""
    high = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
    data = _FOLD[data]
    data[high] += 0x20
    space = data == 0x20
    gone = np.flatnonzero(space[1:] & space[:-1]) + 1
    return np.delete(data, gone), offs - np.searchsorted(gone, offs)


class SuffixAutomaton:
    """All substrings of a text. A state is where its row of `table` begins, 0 the root; `table[state + code]` is the next
    state, or -1."""

    def __init__(self, text: bytes):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.size = len(text)
        self.code = np.zeros(256, np.int32)
        for k, c in enumerate(sorted(set(text))):
            self.code[c] = k + 1
        letters = len(set(text)) + 1
        self.table = np.full(len(nexts) * letters, -1, np.int32)
        at = np.fromiter((s * letters for s, n in enumerate(nexts) for _ in n), np.int64)
        by = np.fromiter((c for n in nexts for c in n), np.int64)
        self.table[at + self.code[by]] = np.fromiter((t * letters for n in nexts for t in n.values()), np.int32)

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next states; where a phrase ended (or a byte was unknown), and the phrases that ended there."""
        after = self.table[state + codes]
        bad = np.flatnonzero(after < 0)
        again = self.table[codes[bad]]
        after[bad] = np.maximum(again, 0)
        return after, bad, (state[bad] != 0).astype(np.int64) + (again < 0)

    def run(self, piece: bytes, state: int) -> tuple[int, int]:
        """Phrases that end in a piece, and the state behind it: one byte at a time."""
        table, count = memoryview(self.table), 0
        for code in self.code[np.frombuffer(piece, np.uint8)].tolist():
            after = table[state + code]
            if after < 0:
                again = table[code]
                count += (state != 0) + (again < 0)
                after = max(again, 0)
            state = after
        return count, state

    def phrases(self, columns: np.ndarray, lengths: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Phrases of each piece, those that end with a text included. Column t of `columns` holds byte t of every piece,
        longest piece first; before and behind: the pieces beside each in its text, -1 at the ends."""
        count = np.zeros(len(lengths), np.int64)
        end = np.zeros(len(lengths), np.int32)
        live = np.searchsorted(-lengths, -np.arange(columns.shape[0]), "left")
        for t in range(columns.shape[0]):
            m = live[t]
            end[:m], bad, gain = self.step(end[:m], self.code[columns[t, :m]])
            count[bad] += gain
        alone, plus = end.copy(), np.zeros(len(lengths), np.int64)
        todo = np.flatnonzero((before >= 0) & (end[before] != 0))
        for _ in range(ROUNDS):
            if not len(todo):
                break
            was, entry = end[todo], end[before[todo]]
            plus[todo], end[todo] = 0, alone[todo]
            left, true, guess = todo, entry, np.zeros(len(todo), np.int32)
            for t in range(columns.shape[0]):
                stay = lengths[left] > t
                if not stay.all():
                    gone = left[~stay]
                    end[gone] = true[~stay]
                    left, true, guess = left[stay], true[stay], guess[stay]
                if not len(left):
                    break
                codes = self.code[columns[t, left]]
                true, bad, gain = self.step(true, codes)
                plus[left[bad]] += gain
                guess, bad, gain = self.step(guess, codes)
                plus[left[bad]] -= gain
                apart = true != guess
                left, true, guess = left[apart], true[apart], guess[apart]
            end[left] = true
            moved = todo[end[todo] != was]
            todo = behind[moved][behind[moved] >= 0]
        for k in todo.tolist():
            while k >= 0:
                n, state = self.run(columns[: lengths[k], k].tobytes(), int(end[before[k]]))
                plus[k], settled, end[k] = n - count[k], end[k] == state, state
                k = -1 if settled else int(behind[k])
        return count + plus + ((behind < 0) & (end != 0))


def parse_counts(automata: list[SuffixAutomaton], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Phrases of each text under each automaton."""
    size = np.diff(offs)
    pieces = -(-size // PIECE)
    doc = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    out = np.zeros((len(automata), len(size)), np.int64)
    if not len(doc):
        return out
    start = offs[:-1][doc] + nth * PIECE
    length = np.minimum(size[doc] - nth * PIECE, PIECE)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.where(nth > 0, np.concatenate([[0], place[:-1]]), -1)[order]
    behind = np.where(nth < pieces[doc] - 1, np.append(place[1:], 0), -1)[order]
    doc, start, length = doc[order], start[order], length[order]
    padded = np.concatenate([data, np.zeros(PIECE, np.uint8)])
    columns = np.empty((int(length[0]), len(start)), np.uint8)
    for t in range(len(columns)):
        np.take(padded, start + t, out=columns[t])
    for k, automaton in enumerate(automata):
        out[k] = np.bincount(doc, automaton.phrases(columns, length, before, behind), len(size)).astype(np.int64)
    return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> list[tuple[str, bytes]]:
    """The sample of each language: passages of SAMPLE_ROWS rows chosen by hash, whatever their length.

    The whole text of a chosen row is cut into passages, between characters always; first one passage of every row is
    taken, then a second one, and so on in an order of hashes, as long as they fit into SAMPLE_BYTES. Equal rows count once.
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text)).alias("h")
    )
    chosen = usable.select("lang", "h").distinct()
    for keys in (["lang", F.pmod("h", F.lit(SPLIT))], ["lang"]):  # the first in each part of a language, then the first of those
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        chosen = chosen.withColumn("n", place).filter(F.col("n") <= SAMPLE_ROWS).select("lang", "h")
    chosen = chosen.collect()
    if not chosen:
        return []
    picked = spark.createDataFrame(chosen, "lang string, h bigint")  # fewer bytes than the sample itself
    rows = usable.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])
    cut = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PASSAGE}}}(?=\s|$)|.{{1,{PASSAGE}}}"), F.lit(0))
    passages = rows.select("lang", "h", F.posexplode(cut).alias("at", "passage")).withColumn("g", F.xxhash64("h", "at"))
    turn = passages.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "h").orderBy("g")))
    order = Window.partitionBy("lang").orderBy("turn", "g")
    held = F.sum(F.octet_length("passage") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = turn.select("lang", "passage", "turn", "g", held.alias("held")).filter(F.col("held") <= SAMPLE_BYTES)
    samples: dict[str, bytes] = {}
    for row in taken.orderBy("lang", "turn", "g").collect():
        raw = row["passage"].encode()
        samples[row["lang"]] = samples.get(row["lang"], b"") + fold(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes() + b"\n"
    return sorted(samples.items())


def predict(docs: DataFrame, samples: list[tuple[str, bytes]], text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep: list[str | Column] | None = None, fits_out: str | None = None) -> DataFrame:
    """The kept columns (default: all but those of the results' names) with the predicted language and its score, and on
    request whether the text fits it: whether its phrases, but for one, cost no more bits than its bytes have."""
    spark = docs.sparkSession
    names = [name for name, _ in samples]
    shared = spark.sparkContext.broadcast([SuffixAutomaton(s) for _, s in samples])
    columns = keep if keep is not None else [c for c in docs.columns if c not in (lang_out, score_out, fits_out)]
    kept = docs.select(*columns)
    own = keep is None and text in kept.columns  # the text is among the kept columns and sent once
    source = docs.select(*columns, *([] if own else [F.col(text).alias("_q_text")]), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_q_letter"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, `{lang_out}` string, `{score_out}` double" + f", `{fits_out}` boolean" * bool(fits_out)

    kept_names = kept.columns

    def run(batches):
        automata = shared.value
        bits = np.array([math.log2(a.size + 1) for a in automata])
        for batch in batches:
            column = batch.column(text if own else "_q_text")
            data, offs = text_arrays(column)
            found, scores, fits = [], [], []
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
                part, edges = fold(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                if names:
                    cost = parse_counts(automata, part, edges) * bits[:, None]
                    order = np.argsort(cost, axis=0, kind="stable")
                    best = np.take_along_axis(cost, order, 0)
                    score = 1 - best[0] / np.maximum(best[1], 1e-9) if len(names) > 1 else np.ones(j - i)
                    found.extend(names[k] for k in order[0])
                    scores.append(np.clip(score, 0, 1))
                    fits.append(best[0] <= 8 * np.diff(edges) + bits[order[0]])
                else:
                    found.extend([UND] * (j - i))
                    scores.append(np.zeros(j - i))
                    fits.append(np.zeros(j - i, bool))
                i = j
            empty = ~np.asarray(batch.column("_q_letter"))
            score = np.where(empty, 0.0, np.concatenate(scores) if scores else np.zeros(0))
            lang = pc.if_else(pa.array(empty), UND, pa.array(found, pa.string()))
            made = {lang_out: lang, score_out: pa.array(score)}
            if fits_out:
                made[fits_out] = pa.array(np.concatenate(fits) & ~empty if fits else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept_names))), *made.values()], names=[*kept_names, *made])

    return source.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    samples = learn(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, samples, keep=["doc_id", held_out().alias("held_out")])
