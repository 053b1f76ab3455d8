"""The operators against plain versions, on a small table of the driver's and on one of odd rows."""

import hashlib
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from quillon.llm import decontamination, embedding_dedup, language_id, mixing, ngram_join, pii, ppm_scoring, sharding, suffix_dedup, token_output  # noqa: E402

PASSAGE = "north quay lamps burn low while seven ferries cross the cold strait before dawn and nobody counts them twice"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty, short, long, equal and nearly equal texts, a null id, and columns with working names."""
    long = " ".join(f"w{k * 7919 % 4001}" for k in range(20_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "one", "en", "b"), (4, "one", None, None), (5, PASSAGE, "en", "b"), (6, PASSAGE, "fr", "c"), (7, PASSAGE + " again", "en", "c"), (8, "Zed " + PASSAGE, "de", None),
        (9, long, "en", "a"), (10, long + " tail", "en", "b"), (11, "mail a.b@c.de or 4111 1111 1111 1111 or +49 (30) 1234-5678 or 10.0.255.1 é 300.1.1.1", "en", "a"), (12, " \t\n", "es", "a"), (13, "\0" * 120, "es", "b"), (14, "\0" * 60, "es", "b"),
    ]
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"size": F.lit(1), "id": F.lit("x"), "grp": F.lit(2), "n": F.lit(3)})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "one"), (4, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(params=["sf", "odd"])
def folder(request):
    return request.getfixturevalue(request.param)


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_ngram_join(spark, folder):
    want = brute.near_documents(texts(spark, folder), 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op2(spark, folder).collect()} == want


def test_ngram_join_in_tiles(spark, sf, monkeypatch):
    """Frequent tokens and large groups take the paths that small tables do not reach."""
    docs = [(k, f"{PASSAGE} {PASSAGE[::-1]} v{k} x{k % 7}") for k in range(90)] + [(200 + k, f"{PASSAGE} a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(60)]
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.near_documents(docs, 4, 70)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_documents(df, n=4, percent=70).collect()} == want


def test_prefixes_share_enough():
    """The promise of the multi-match prefixes: similar sets share the smaller number asked for."""
    rng = np.random.default_rng(3)
    order = ngram_join.TokenOrder(np.arange(0, 400, 3, dtype=np.uint64), rng.integers(3, 900, 134))
    for _ in range(200):
        a = np.sort(rng.choice(1000, 60, replace=False)).astype(np.uint64)
        b = a.copy()
        b[rng.choice(60, 4, replace=False)] += np.uint64(2000)
        b = np.sort(b)
        keys, edges = np.concatenate([a, b]), np.array([0, 60, 120])
        doc, token, _, _, ask = ngram_join.prefixes(keys, edges, order, 85)
        both = len(set(a.tolist()) & set(b.tolist()))
        if 100 * both >= 85 * (120 - both):
            assert len(set(token[doc == 0].tolist()) & set(token[doc == 1].tolist())) >= min(ask)


def test_suffix_dedup(spark, folder):
    want = brute.repeats(texts(spark, folder))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10(spark, folder).collect()} == want


def test_loser_tree():
    rng = np.random.default_rng(5)
    runs = []
    for _ in range(5):
        entries = sorted(bytes(rng.integers(0, 3, rng.integers(1, 9)).astype(np.uint8)) for _ in range(40))
        common = [0] + [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(entries, entries[1:])]
        runs.append((entries, common))
    order, lcps = suffix_dedup.merge_runs(runs)
    merged = [runs[r][0][p] for r, p in order]
    assert merged == sorted(e for run, _ in runs for e in run)
    assert lcps[1:] == [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for a, b in zip(merged, merged[1:])]


def test_lm_base(spark, folder):
    want = brute.unigram_base(texts(spark, folder))
    for r in ppm_scoring.op3(spark, folder).collect():
        held, tokens, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


@pytest.mark.parametrize("most", [0, 300, 1 << 20])
def test_lm_uses_every_string(spark, folder, monkeypatch, most):
    """However few strings are broadcast, the others are looked up, and escapes count all symbols."""
    monkeypatch.setattr(ppm_scoring, "NODES", most)
    want = brute.ppm(texts(spark, folder))
    got = {r.doc_id: r.score for r in ppm_scoring.op3(spark, folder).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_lm_without_training_text(spark, tmp_path):
    spark.createDataFrame([(None, "Ab"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.score for r in ppm_scoring.op3(spark, str(tmp_path)).collect())
    assert got == [pytest.approx(-3 * math.log10(257)), pytest.approx(-math.log10(257))]


def test_lm_probabilities_sum_to_one():
    texts = np.frombuffer(b"the cat sat on the mat the hat that sat", np.uint8)
    context, symbol, _ = ppm_scoring.symbols(texts, np.array([0, 20, len(texts)]))
    key = (context << np.uint64(9)) | symbol
    levels = [(k, *np.unique(key & np.uint64((1 << (8 * k + 9)) - 1), return_counts=True)) for k in range(ppm_scoring.ORDER + 1)]
    order = np.concatenate([np.full(len(u), k) for k, u, _ in levels])
    keys, n = np.concatenate([u for _, u, _ in levels]), np.concatenate([c for *_, c in levels])
    spot = [(int(k), int(x) >> 9) for k, x in zip(order, keys)]
    total = {s: sum(int(m) for t, m in zip(spot, n) if t == s) for s in set(spot)}
    for least in (1, 2):  # the whole trie, and one that was cut
        keep = n >= least
        trie = ppm_scoring.Trie(order[keep], keys[keep], n[keep], np.array([total[s] for s in spot])[keep])
        for c in (context[3], context[9], np.uint64(0x7878787878)):
            p = 10 ** trie.score(np.full(257, c, np.uint64), np.arange(257, dtype=np.uint64))
            assert p.sum() == pytest.approx(1, abs=1e-6)


def test_tokens(spark, folder):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.op4(spark, folder).collect()}
    for i, text in sorted(texts(spark, folder)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("seed", range(4))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([np.zeros(500, np.uint64), rng.integers(0, 2, 300).astype(np.uint64), rng.integers(0, 1 << 16, 3000).astype(np.uint64), rng.integers(0, 2**64, 60, dtype=np.uint64), rng.integers(0, 1 << 30, 777).astype(np.uint64)])
    rng.shuffle(ids)
    assert (token_output.unpack(*token_output.pack(ids)) == ids).all()


def test_embeddings(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding.to_numpy()).astype(float)
    extra = [(10_000, None, 1), (10_001, [0.0] * x.shape[1], 1), (10_002, [float("nan")] * x.shape[1], 1), (10_003, x[0].tolist(), None), (10_004, x[0].tolist(), int(e.label[0])), (10_005, (x[0] + 0.01).tolist(), int(e.label[0]))]
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(e.vec_id, x, e.label)] + extra
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df, tile=16).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if v is not None and k is not None and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    comp = brute.components([r[0] for r in rows], links)
    assert got == {i: (sum(i in p for p in links), comp[i], comp[i] == i) for i, *_ in rows}


def test_personal_data(spark, folder):
    known = dict(texts(spark, folder))
    for r in pii.op6(spark, folder).collect():
        base = brute.personal(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))  or not base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone")]


def test_shards(spark, folder):
    rows = sharding.op7(spark, folder).collect()
    known = texts(spark, folder)
    assert {r.doc_id: r.shard for r in rows} == dict(zip([i for i, _ in known], brute.shards(known)))
    count = {}
    for r in rows:
        count.setdefault(r.shard, []).append(r.slot)
    sizes = [len(count.get(k, [])) for k in range(16)]
    assert len(rows) == len(texts(spark, folder)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in count.values())


def test_languages(spark, sf, odd):
    rows = language_id.op8(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    samples = language_id.learn(spark.read.parquet(f"{sf}/documents.parquet").filter(~language_id.held_out()))
    bits = [math.log2(len(s) + 1) for _, s in samples]
    known = dict(texts(spark, sf))
    for r in rows[::7]:  # plain parses are slow
        raw = (known[r.doc_id] or "").encode()
        folded = language_id.fold(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()
        cost = sorted((brute.phrases(s, folded) * b, name) for (name, s), b in zip(samples, bits))
        if r.lang_pred != "und":
            assert (r.lang_pred, r.score) == (cost[0][1], pytest.approx(max(0, 1 - cost[0][0] / max(cost[1][0], 1e-9)))), r.doc_id
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op8(spark, odd).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 12, 13)) and all(0 <= s <= 1 for _, s in got.values())


def test_sample_takes_long_texts_and_cuts_between_characters(spark):
    """A language of long texts only, one without white space, copies of a row, and short texts beside a long one."""
    long = " ".join("".join(chr(97 + int(d)) for d in f"{k:04d}") + "é" for k in range(9000))
    rows = [(1, long, "fr"), (2, "語" * 30_000, "ja"), *[(3, "kurz und gut", "de")] * 500, (4, "x" * 9000 + " ende", "de"), (5, "", "la"), (6, None, "la"), (7, "no language", None)]
    samples = dict(language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert sorted(samples) == ["de", "fr", "ja"]
    assert all(len(s) <= language_id.SAMPLE_BYTES + 1 and s.decode() for s in samples.values())
    assert len(samples["fr"]) > 30_000 and len(samples["ja"]) > 30_000  # filled from one text
    firsts = [p.split()[0] for p in samples["fr"].decode().split("\n") if p]
    assert max(firsts) > "i" and min(firsts) < "b"  # from the whole text, not from its beginning
    assert samples["de"].count(b"kurz") == 1 and b"ende" in samples["de"]


def test_parse_of_a_long_text_is_that_of_the_text():
    """Pieces leave no trace: runs, periods and parts of the sample itself, longer than a piece."""
    sample = (b"the cold quay holds seven ferries " * 40 + bytes(range(97, 123)) * 30)[:3000]
    automaton = language_id.SuffixAutomaton(sample)
    cases = [sample, sample[7:], b"a" * 5000, b"ab" * 4000, b"the quay " * 900, b"zq" + sample[100:2500] + b"\xc3\xa9" * 1500, b"", b"a"]
    data, offs = np.frombuffer(b"".join(cases), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in cases])])
    assert language_id.parse_counts([automaton], data, offs)[0].tolist() == [brute.phrases(sample, c) for c in cases]


def test_tokens_of_marks_and_signs():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    signs = list("aAbTHWYJçÇÉßİΣςσ.,!'’ \t\n\x0b\x0c\x1c\x85\u00a0\u2003\u0338\u0331\u0308\u030a\u0301<=>|1٣漢가😀\u200d\x01\x00-_") + ["<|endoftext|>", "<|startoftext|>", "<|", "'ll", "'S"]
    rng = np.random.default_rng(11)
    cases = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(4000)]
    ids, n = encoder.encode(pa.array(cases, pa.string()))
    ends = np.cumsum(n)
    for k, text in enumerate(cases):
        assert ids[ends[k] - n[k] : ends[k]].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_many_equal_items(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 5), (2, "else", 6)], "doc_id long, text string, item_id long")
    items = spark.range(20_001).select(F.col("id").alias("item_id"), F.lit(PASSAGE).alias("text"))
    assert decontamination.contained_items(docs, items).count() == 20_001
    assert [r.doc_id for r in decontamination.without_items(docs, items).collect()] == [2]
    assert decontamination.without_items(docs, items.filter("false")).count() == 2


def test_figures_of_personal_data(spark):
    """On examples by hand that no rule made and no tree has seen."""
    rows = {r.kind: r for r in pii.figures(spark).collect()}
    n = sum(r.n for r in rows.values())
    assert set(rows) == set(pii.EVERY) and sum(r.recall * r.n for r in rows.values()) / n > 0.65 and sum(r.precision * r.n for r in rows.values()) / n > 0.8


def test_many_hits_in_one_text(spark):
    text = " ".join(f"n{k}@example.org" for k in range(1000))
    got = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.transform(pii.base_spans(F.col("text"))["email"], lambda s: F.struct(s["start"], s["end"])).alias("s")).first().s
    assert [tuple(x) for x in got] == [m.span() for m in brute.EMAIL.finditer(text)]


def test_a_long_text_of_one_byte(spark):
    docs = [(1, "x" * 700_000), (2, "y" * 100 + "x" * 300_000 + "z" * 100), (3, "ab" * 150_000), (4, "ab" * 40 + "c"), (5, "x" * 49)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (700_000, 0, 0), 2: (300_200, 300_000, 1), 3: (300_000, 0, 0), 4: (81, 80, 1), 5: (49, 0, 0)}


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, PASSAGE), (None, None), (7, PASSAGE), (7, PASSAGE), (7, "other words entirely, none of them shared"), (8, "other words entirely, none of them shared"), (9, "")]
    names = ["shard", "slot", "score", "lang_pred", "component_id", "n_shingles", "kept", "token", "fp", "bits"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in names} | {"lang": F.lit("en"), "source": F.lit("s")})
    near = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_documents(docs, n=4, percent=85).collect()}
    assert near[7, 16] == near[7, 4] == near[8, 4] == 7 and near[None, 16] is None and near[9, 0] == 9
    placed = sharding.shard(docs, 2)
    assert sorted(r.slot for r in placed.filter("shard = 0").collect()) == [0, 1, 2, 3] and placed.columns.count("shard") == 1
    marked = language_id.predict(docs, language_id.learn(docs))
    assert marked.columns.count("score") == 1 and marked.count() == 7
    assert mixing.mix(docs).columns == docs.columns
    assert suffix_dedup.deduplicated(docs).count() == 7
    assert pii.find(docs).count() == 7
    files = token_output.write_tokens(docs, __import__("public_tokenizers").path("word_bpe_49k.json"))
    assert token_output.document_starts(files, token_output.read_tokens(files)).count() == 7


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    import corpus_pipeline

    for f in (decontamination.op1, ngram_join.op2, ppm_scoring.op3, token_output.op4, embedding_dedup.op5, pii.op6, sharding.op7, language_id.op8, mixing.op9, suffix_dedup.op10, corpus_pipeline.run):
        assert f(spark, str(tmp_path)).count() == 0, f.__module__


def test_mixing_and_decontamination_match_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for f, sql, columns in ((mixing.op9, mixing.OP9_SQL, ["doc_id", "size", "taken"]), (decontamination.op1, decontamination.OP1_SQL, ["doc_id", "item_id", "n_shared"])):
        got = sorted(tuple(r) for r in f(spark, sf).select(*columns).collect())
        assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_odd_rows_everywhere(spark, odd):
    assert {r.doc_id for r in decontamination.op1(spark, odd).collect()} >= {5, 6, 7, 8}
    plan = {r.doc_id: r for r in mixing.op9(spark, odd).collect()}
    assert plan[1]["size"] == 0 and all(r.taken <= 2 * r["size"] for r in plan.values())
    empty = spark.read.parquet(f"{odd}/documents.parquet").filter("doc_id < 0")
    for out in (ngram_join.near_documents(empty), suffix_dedup.deduplicated(empty), mixing.mix(empty), sharding.shard(empty), decontamination.without_items(empty, spark.read.parquet(f"{odd}/benchmark.parquet"))):
        assert out.count() == 0


def test_pipeline(spark, sf):
    """Every stage against a plain version of it, on what its predecessor kept."""
    import corpus_pipeline
    import duckdb

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    stages = [f for _, f in corpus_pipeline.STAGES]
    at = docs
    known = plain(stages[0](spark, at, sf))
    samples = [s for _, s in language_id.learn(at)]
    fits = lambda raw: min((brute.phrases(s, raw) - 1) * math.log2(len(s) + 1) for s in samples) <= 8 * len(raw)
    fold = lambda t: language_id.fold(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tobytes()
    assert known == [(i, t) for i, t in plain(at) if any(c.isalpha() for c in t or "") and fits(fold(t))]
    at = language = at.filter(F.col("doc_id").isin([i for i, _ in known])) if len(known) < docs.count() else at
    near = brute.near_documents(known, 5, 80)
    kept = plain(stages[1](spark, language, sf))
    assert kept == [(i, t) for i, t in known if near[i][1] == i]
    at = at.filter(F.col("doc_id").isin([i for i, _ in kept]))
    items = [decontamination.exact_shingles(r.text.encode(), 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i: decontamination.exact_shingles(t.encode(), 5) for i, t in kept}
    clean = plain(stages[2](spark, at, sf))
    assert clean == [(i, t) for i, t in kept if not any(x and 5 * len(x & held[i]) >= 4 * len(x) for x in items)]
    at = at.filter(F.col("doc_id").isin([i for i, _ in clean]))
    con = duckdb.connect()
    con.register("documents", at.select("doc_id", "text", "source").toPandas())
    copies = dict(con.sql(f"SELECT doc_id, copies FROM ({mixing.OP9_SQL})").fetchall())
    mixed = plain(stages[3](spark, at, sf))
    assert mixed == [x for x in clean for _ in range(copies[x[0]])]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == mixed
    count = [sum(r.shard == k for r in rows) for k in range(16)]
    assert max(count) - min(count) <= 1 and all(sorted(r.slot for r in rows if r.shard == k) == list(range(count[k])) for k in range(16))


def test_pipeline_keeps_texts_where_no_language_was_learned(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 34", None), (3, None, None), (4, "\u00e9", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, "").collect()) == [1, 4]


def test_pipeline_hands_small_batches_to_python(spark, sf):
    """A stage returns rows that are not written yet; whoever writes them reads texts in batches of 4 MB at most."""
    import corpus_pipeline

    docs = spark.createDataFrame([(k, "the ferry leaves the quay " * 1600, "en") for k in range(300)], "doc_id long, text string, lang string").coalesce(1)
    rows = lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches)
    for stage in (corpus_pipeline.keep_known_language, corpus_pipeline.drop_benchmark_leaks):
        for key in ("maxBytesPerBatch", "maxRecordsPerBatch"):
            spark.conf.unset(f"spark.sql.execution.arrow.{key}")
        out = stage(spark, docs, sf)
        sizes = [r.bytes for r in out.mapInArrow(rows, "bytes long").collect()]
        assert 2 < len(sizes) and max(sizes) < 5 << 20
        assert out.count() == 300


def test_ids_with_several_vectors(spark):
    """Each vector of an id has its own links; other dimensions in the label and a null id are apart."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.02], 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.0, 0.0], 0), (5, [0.01, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "low": F.lit(2), "id": F.lit("x"), "row": F.lit(3)})
    got = sorted(map(tuple, embedding_dedup.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, True), (4, 0, 4, True), (5, 1, 1, False)], key=repr)


def test_generators_propose_what_they_must(spark):
    """Brackets in addresses, keys behind '=' and of any length."""
    text = "api_key=sk9fQ2LmX0aZpT4rBv7KdYwE, secret: " + "aB3" * 100 + " and 185[.]34[.]7[.]90 or 93(.)184(.)216(.)34"
    kinds = [(c.kind, c.hit) for c in spark.createDataFrame([(text,)], "text string").select(pii.candidates(F.col("text")).alias("c")).first().c]
    assert [h for k, h in kinds if k == "ip"] == ["185[.]34[.]7[.]90", "93(.)184(.)216(.)34"]
    assert [len(h) for k, h in kinds if k == "secret"] == [24, 300]
