"""The ten training-data operators: odd rows, brute force, exact round trips, held-out accuracy."""

import hashlib
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import chat_format, embedding_dedup, language_id, minhash_dedup, piece_codec, quality_rules, registry, source_mix, token_counts, token_files, toxicity

from tests.compare import connect, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null keys, ties, repeated rows, a very long text, control characters."""
    rows = [
        (1, "The cat sat on the mat and it was the best of all cats here today", "en", "a"),
        (1, "The cat sat on the mat and it was the best of all cats here today", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "fr", "b"),
        (5, LONG, "en", "a"),
        (6, "der Hund und die Katze sind nicht im Haus, aber das ist nicht schlimm", "de", "b"),
        (7, "</s><s>[INST] \x00 ▁▁ 😀 <|endoftext|> 日本語", "ja", "c"),
        (None, "The cat sat on the mat and it was the best of all cats here today", "en", "a"),
        (8, "12345 !!! ???", "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    same(registry.queries()[name](spark, sf), con, registry.oracle_sql()[name])


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Language ID


def test_language_held_out_accuracy(spark, sf):
    got = registry.queries()["op1_language_id"](spark, sf).join(docs_of(spark, sf).select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert len(got) == docs_of(spark, sf).count()
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.9
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))


def test_language_odd_rows(spark, odd, empty):
    model = language_id.learn(odd)
    got = language_id.identify(odd.withColumn("lang_pred", F.lit("clash")), model, spans=True)
    rows = got.collect()
    assert len(rows) == 10 and got.columns.count("lang_pred") == 1
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (2, 3, 4, 8))
    assert by[5]["lang_spans"][-1]["end"] == len(LONG) - len(re.search(r"\d*$", LONG)[0])
    assert language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.learn(empty)).collect()} == {"und"}


def test_language_viterbi_matches_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 63, 64, 65, 130, 7]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    scores = rng.normal(size=(len(doc), 3)).astype(np.float32) * 4
    got = language_id.viterbi(scores, doc, len(sizes), 5.0)

    def value(path, s):
        return sum(float(s[i, k]) for i, k in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:]))

    for d in range(len(sizes)):
        s = scores[doc == d]
        best = np.zeros(3)
        for row in s:
            best = np.maximum(best, best.max() - 5.0) + row if best is not None else row
        if len(s):
            first = s[0].astype(float)
            for row in s[1:]:
                first = np.maximum(first, first.max() - 5.0) + row
            assert abs(value(got[doc == d].tolist(), s) - first.max()) < 1e-3


def test_language_walk_by_words_equals_walk_by_chunks(monkeypatch):
    rng = np.random.default_rng(8)
    sizes = [3, 0, 150, 64, 1, 129]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    scores = (rng.integers(-40, 40, size=(len(doc), 5)) / 4).astype(np.float32)
    value = lambda path, s: sum(float(s[i, k]) for i, k in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))
    chunks = language_id.viterbi(scores, doc, len(sizes), 3.0)
    monkeypatch.setattr(language_id, "BACK_BYTES", 0)
    words = language_id.viterbi(scores, doc, len(sizes), 3.0)
    for d in range(len(sizes)):
        assert abs(value(chunks[doc == d].tolist(), scores[doc == d]) - value(words[doc == d].tolist(), scores[doc == d])) < 1e-3


def brute_language(model, text):
    """Words, scripts, trigram scores and the path, one step at a time; the languages of other scripts are left out."""
    t = language_id._tables()
    words = ["".join(run) for letters, run in itertools.groupby(text or "", str.isalpha) if letters]
    if not words:
        return "und", 0.0
    scripts = {int(t["script"][ord(w[0])]) for w in words}
    fits = [k for k in range(len(model.languages)) if any(model.allowed[s, k] for s in scripts)] or list(range(len(model.languages)))
    rows, knows = [], []
    for w in words:
        c = [0, *(int(t["lower"][ord(x)]) for x in w), 0]
        score = np.zeros(len(fits))
        for i in range(1, len(c)):
            h = ((c[i - 2] if i > 1 else 0) * 0x9E3779B1 + c[i - 1] * 0x85EBCA77 + c[i] * 0xC2B2AE3D) & 0xFFFFFFFF
            h ^= h >> 15
            h = (h * 0x2C1B3C6D) & 0xFFFFFFFF
            score += model.weights[(h >> 16) & (language_id.BUCKETS - 1)][fits]
        own = np.array([model.allowed[t["script"][ord(w[0])], k] for k in fits])
        if not own.any():
            score[:], own = 0, np.ones(len(fits), bool)
            knows.append(False)
        else:
            knows.append(len(fits) < len(model.languages) or bool(np.ptp(np.where(own, score, -1e4)) > 0))
        rows.append(np.where(own, score, -1e4))
    best, back = rows[0].copy(), []
    for row in rows[1:]:
        top = int(best.argmax())
        moves = best[top] - language_id.SWITCH_PENALTY > best
        back.append(np.where(moves, top, np.arange(len(fits))))
        best = np.where(moves, best[top] - language_id.SWITCH_PENALTY, best) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    if not any(knows):
        return model.languages[model.common], 1 / len(model.languages)
    letters = np.bincount(path, weights=[len(w) for w in words], minlength=len(fits))
    total = np.sum(rows, axis=0)
    pick = max(range(len(fits)), key=lambda k: (letters[k], total[k], -k))
    return model.languages[fits[pick]], letters[pick] / letters.sum()


def test_language_query_matches_brute_force(spark, sf):
    docs = docs_of(spark, sf)
    model = language_id.learn(docs)
    got = {r["doc_id"]: r for r in registry.queries()["op1_language_id"](spark, sf).collect()}
    for d in docs.collect():
        lang, score = brute_language(model, d["text"])
        assert got[d["doc_id"]]["lang_pred"] == lang and abs(got[d["doc_id"]]["score"] - score) < 1e-6, d["doc_id"]


def test_language_scripts_narrow_the_candidates(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("кот и дом большой", "ru"), ("кіт і дім великий", "uk"), ("the cat and the house", "en"), ("γάτα και σπίτι", "el")] * 8)]
    model = language_id.learn(spark.createDataFrame(rows, DOCS))
    scripts = lambda *names: sum(1 << language_id.SCRIPTS.index(n) for n in names)
    assert model.narrowed(scripts("Greek")).languages == ["el"] and model.narrowed(scripts("Cyrillic")).languages == ["ru", "uk"]
    said, score, _ = language_id.label_texts(model, ["большой дом", "σπίτι", "the house", "ไทย", "the house дом большой и кот"])
    assert said[:3] == ["ru", "el", "en"] and score[1] == 1.0 and score[3] == 1 / 4 and said[4] == "ru"


def test_language_spans_of_mixed_text(spark, sf):
    docs = docs_of(spark, sf)
    model = language_id.learn(docs)
    best = lambda lang: docs.filter((F.col("lang") == lang) & (F.col("n_chars") > 800)).orderBy("doc_id").first()["text"][:600]
    text = best("en") + " " + best("de")
    _, _, spans = language_id.label_texts(model, [text], spans=True)
    assert spans[0][0][2] == "en" and spans[0][-1][2] == "de" and spans[0][-1][1] <= len(text)


# Toxicity


def test_toxicity_held_out(spark, sf):
    got = registry.queries()["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    clean = got[got.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.95
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()


def brute_toxicity(model, text):
    """Clause by clause, each rule by itself, without the composed machine and the automaton."""
    scores = []
    for clause in re.split(r"[.!?;:\n]", toxicity.lowered(text or "")):
        target = pending = reported = False
        near, total, found = 0, 0.0, 0
        for w in toxicity.WORD.findall(clause):
            stem = next((w[:n] for n in reversed(toxicity.STEM_LENGTHS) if len(w) > n and w[:n] in model.stems), None)
            insult = model.stems[stem] if stem else model.words.get(w, 0.0)
            kind = "insult" if insult > 0 else next((k for k, ws in (("threat", toxicity.THREATS), ("report", toxicity.REPORTS), ("negation", toxicity.NEGATIONS), ("target", toxicity.TARGETS)) if w in ws), "other")
            factor = (0.6 if near and kind in ("insult", "threat", "target") else 1.0) * (0.8 if reported and kind in ("insult", "threat", "target") else 1.0)
            if kind == "insult":
                total += insult * factor * (1.25 if target else 1.0)
            if kind == "threat":
                total += toxicity.THREAT_WEIGHT * factor * (1.0 if target else 0.2)
                pending |= not target
            if kind == "target":
                total += toxicity.THREAT_WEIGHT * 0.8 * factor if pending else 0.0
                target, pending = True, False
            found += kind in ("insult", "threat")
            reported |= kind == "report"
            near = 3 if kind == "negation" else max(0, near - 1)
        if found and total > 0:
            scores.append(total)
    x, y = (max(scores) / 10, sum(scores) / 10) if scores else (0.0, 0.0)
    b, c, d = model.coefficients
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + c * x + d * y))))


def test_toxicity_query_matches_brute_force(spark, sf):
    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    again = toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert (model.words, model.stems) == (again.words, again.stems) and np.allclose(model.coefficients, again.coefficients, atol=1e-9)
    got = {r["doc_id"]: r for r in registry.queries()["op2_toxicity"](spark, sf).collect()}
    for d in docs.collect():
        want = brute_toxicity(model, d["text"])
        assert abs(got[d["doc_id"]]["score"] - want) < 1e-6 and got[d["doc_id"]]["predicted"] == int(got[d["doc_id"]]["score"] >= 0.3)


def test_toxicity_recall_on_held_out_rows(spark):
    """On a larger table: most held-out toxic texts are found, and clean ones are left alone."""
    sf = "/root/testdata/sf0.1"
    got = registry.queries()["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert len(toxic) >= 50 and (toxic.predicted == 1).mean() > 0.8 and (clean.predicted == 0).mean() > 0.99


def test_toxicity_places_and_copies(spark):
    machine = toxicity.ToxicityModel(words={"scum": 5.0}).machine()
    assert [m[:2] for m in machine.matches("İİ. You scum! x")] == [(3, 12)]
    rows = [(i, "a b c d e f g scum " * 3, "en", "s", 0) for i in (1, 3, 5)]
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(spark.createDataFrame(rows, DOCS), labels, 100).collect()
    assert [r["toxic"] for r in sample] == [max(0 if i != 3 else 1 for i in (1, 3, 5) if zlib.crc32(str(i).encode()) % 4 != 2)]


def test_toxicity_grammar():
    machine = toxicity.ToxicityModel(words={"scum": 5.0}, stems={"lowei": 4.0}).machine()
    plain, target, negated, reported = (machine.clause(t)[0] for t in ("that is scum", "you are scum", "you are not scum", "they said you are scum"))
    assert target > plain > 0 and negated < target and reported < target
    assert machine.clause("i will kill it")[0] < machine.clause("you i will kill")[0]
    assert abs(machine.clause("i will kill you")[0] - machine.clause("you i will kill")[0]) < 1e-9
    assert machine.clause("i will not kill you")[0] < machine.clause("i will kill you")[0]
    assert machine.features("Loweisch and more. Nothing here.")[1] > 0 and machine.features("flowei scums")[1] == 0
    assert [m[:2] for m in machine.matches("Fine. You scum! Fine.")] == [(5, 14)]


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for model in (toxicity.learn(odd, labels), toxicity.learn(empty, labels.limit(0))):
        got = toxicity.score(odd.withColumn("score", F.lit("clash")), model, clauses=True)
        assert got.count() == 10 and all(0 <= r["score"] <= 1 for r in got.collect())
        assert toxicity.score(empty, model).count() == 0


# Chat formatting


def test_chat_escapes_and_examples(spark):
    rows = [(1, 0, "system", "be <|im_end|> good"), (1, 1, "user", "\\<[|"), (1, 2, "assistant", "</s>[INST] ok"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", ""), (None, 0, None, "x"), (2, None, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("stream", F.lit("clash"))
    for chunk in (256, 2):
        formatted = chat_format.format_conversations(df, chunk_turns=chunk)
        for r in formatted.collect():
            for control in ("</s>", "[INST]", "<s>"):
                assert control not in r["stream"]
            assert r["stream"].count("<|im_end|>") == r["n_turns"]
        got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
        told = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:6])
        assert got[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok").hexdigest() and got[1]["loss_chars"] == 13
        assert (got[1]["n_turns"], got[1]["n_examples"], got[2]["n_examples"], got[None]["n_turns"]) == (6, 3, 0, 1)
    examples = chat_format.expand_examples(chat_format.format_conversations(df), with_text=True).orderBy("conv_id", "example").collect()
    assert [chat_format.SEP in e["context"] for e in examples] == [True] * 3
    assert len(examples[0]["context"]) == examples[0]["start"] and chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_examples_reach_over_chunks(spark, monkeypatch):
    """Offsets and contexts are those of the whole conversation, however it is cut, and the digest uses the expansion."""
    rows = [(c, n, "assistant" if n % 2 else "user", f"turn {n} <|of|> é{c}") for c in (1, None) for n in range(7)] + [(1, None, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = ([tuple(e) for e in chat_format.expand_examples(chat_format.format_conversations(df, chunk_turns=n), with_text=True).drop("chunk").orderBy("conv_id", "example").collect()] for n in (256, 2))
    assert len(cut) == 7 and cut == whole
    assert all(len(context) == start and context.count(chat_format.END) >= example for _, example, start, _, _, context in cut)
    calls, expand = [], chat_format.expand_examples
    monkeypatch.setattr(chat_format, "expand_examples", lambda *a, **k: calls.append(1) or expand(*a, **k))
    assert {r["conv_id"]: r["n_examples"] for r in chat_format.digest(chat_format.format_conversations(df, chunk_turns=2)).collect()} == {1: 4, None: 3} and calls


# Near-duplicates


def reference_components(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if den * min(len(sets[a]), len(sets[b])) < num * max(len(sets[a]), len(sets[b])):
                continue  # too unlike in size
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_match_brute_force(spark, sf):
    rows = docs_of(spark, sf).select("doc_id", "text").collect()
    got = registry.queries()["op4_minhash_dedup"](spark, sf).collect()
    want = reference_components([(r[0], r[1]) for r in rows], 3, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_a_chain_and_a_crowd(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):  # each near the base, pairs of them around the threshold
        words = list(base)
        for p in rng.choice(200, 5, replace=False):
            words[p] = f"n{k}x{p}"
        rows.append((k + 10, " ".join(words)))
    chain = list(base[:120])
    for k in range(12):  # links from one to the next only
        chain = [*chain[4:], *[f"c{k}y{j}" for j in range(4)]]
        rows.append((k + 1000, " ".join(chain)))
    rows += [(k + 5000, "same text here") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, 3, 85, 100).collect()}
    assert got == reference_components(rows, 3, 85, 100)


def test_near_duplicates_in_large_buckets(spark):
    """More than a block of distinct near copies, long ones among them, and a bridge between two crowds."""
    rng = np.random.default_rng(11)
    rows = []
    for crowd, n in ((0, 1200), (1, 60)):
        base = [f"c{crowd}w{k}" for k in range(60 if crowd == 0 else 9000)]
        for k in range(n):
            words = list(base)
            for p in rng.choice(len(base), 1 if crowd == 0 else 200, replace=False):
                words[p] = f"x{crowd}y{k}z{p}"
            rows.append((crowd * 10_000 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, 3, 85, 100).collect()}
    assert got == reference_components(rows, 3, 85, 100)


@pytest.mark.parametrize("by", ["BLOCK_MEMBERS", "BLOCK_SET_BYTES"])
def test_near_duplicates_split_into_blocks(spark, monkeypatch, by):
    """Blocks of a few rows or bytes: every pair of blocks meets, and nothing is lost."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(90):
        words = list(base)
        for p in rng.choice(150, 4, replace=False):
            words[p] = f"n{k}x{p}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(minhash_dedup, by, 7 if by == "BLOCK_MEMBERS" else 9000)
    monkeypatch.setattr(minhash_dedup, "SLICE", 2)
    monkeypatch.setattr(minhash_dedup, "WANTED", 3)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == reference_components(rows, 3, 85, 100)


def test_components_of_chains_and_further_edges(spark):
    from foliograph.llm import _graph

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (None, 5), (7, 7), (200, 199)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = _graph.components(df)
    want = {n: 0 for n in range(41)} | {n: 100 for n in (100, 101, 102)} | {199: 199, 200: 199}
    assert {r["node"]: r["component"] for r in found.collect()} == want
    more = _graph.merged(found, spark.createDataFrame([(102, 30), (500, 200), (600, 601)], "a long, b long"))
    want = {n: 0 for n in (*range(41), 100, 101, 102)} | {199: 199, 200: 199, 500: 199, 600: 600, 601: 600}
    assert {r["node"]: r["component"] for r in more.collect()} == want


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = minhash_dedup.near_duplicates(odd.withColumn("words", F.lit(1))).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[4]["kept"] and by[None]["kept"] and by[None]["component_id"] is None
    assert by[5]["n_shingles"] == 29_996
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_sketches_fill_and_estimate():
    a = np.unique(minhash_dedup.mix(np.arange(400, dtype=np.uint64)))
    s = minhash_dedup.sketch([a, a[:1], a[:320], a[:40]])
    assert (s != minhash_dedup.EMPTY).all()
    assert abs((s[0] == s[2]).mean() - 0.8) < 0.15


# Quality rules


def test_quality_odd_rows(spark, odd, empty):
    got = quality_rules.apply_rules(odd.withColumn("kept", F.lit("clash"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[2]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[5]["n_words"] == 30_000 and by[5]["n_repeat_words"] == 0
    assert quality_rules.apply_rules(empty).count() == 0


def test_quality_repeats_match_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 2, 3, 4, 9, 40)] + ["a b a b a b a b", "x y z x y z"]
    got = quality_rules.base_counts(spark.createDataFrame([(i, t, "l", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    for r in got.collect():
        w = texts[r["doc_id"]].split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r["n_repeat_words"] == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_quality_limits_follow_the_groups(spark):
    """A source of junk doesn't set its own limit, and limits are tighter than the fixed ones where a group's texts are alike."""
    rng = np.random.default_rng(5)
    words = lambda lengths: ["".join(rng.choice(list("abcdefgh"), n)) for n in lengths]
    text = lambda: words(rng.integers(3, 8, 60))
    clean = [(100 * s + i, " ".join(text()), "en", f"s{s}", 0) for s in range(4) for i in range(60)]
    junk = [(1000 + i, " ".join(w + "%%" for w in text()), "en", "junk", 0) for i in range(300)]
    long = [(2000, " ".join(words([8] * 60)), "en", "s0", 0)]  # at the fixed limit for the letters of a word, not above it
    kept = {r["doc_id"] for r in quality_rules.apply_rules(spark.createDataFrame(clean + junk + long, DOCS)).filter("kept").collect()}
    assert kept == {r[0] for r in clean}


@pytest.mark.parametrize("n, kept", [(59, 59), (60, 0)])
def test_quality_smallest_group_is_a_parameter(spark, n, kept):
    """A group below min_group takes the wider limit, one above it its own; with two sources neither is bound by the others."""
    rng = np.random.default_rng(6)
    text = lambda length: " ".join("".join(rng.choice(list("abcdefgh"), length)) for _ in range(60))
    rows = [(i, text(5), "en", "a", 0) for i in range(200)] + [(1000 + i, text(5), "en", "b", 0) for i in range(n - 1)] + [(5000, text(5) + " %", "en", "b", 0)]
    rows += [(2000 + i, text(5) + " %%%%", "en", "a", 0) for i in range(150)]
    got = {r["doc_id"] for r in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS), min_group=60, min_sources=3).filter("kept").collect()}
    limits = quality_rules.thresholds(quality_rules.measures(quality_rules.base_counts(spark.createDataFrame(rows, DOCS))), ["lang", "source"], "x", 6.0, 10_000, 60)
    assert limits.count() == (1 if kept else 2) and {r[0] for r in rows if 1000 <= r[0] < 2000} <= got


# Mixing


def test_mix_meets_limits_and_keeps_all(spark, empty, odd):
    rows = [(i, "w " * 50, "en", "big", 0) for i in range(800)] + [(1000 + i, "w " * 50, "en", f"s{i % 4}", 0) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    got = source_mix.mix(df, target_entropy=None, max_repeats=3.0, block_tokens=500)
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert n["big"] == 800 and all(55 <= n[f"s{k}"] <= 61 for k in range(4))
    assert got.select("doc_id").distinct().count() == 880
    tokens = got.groupBy("source").agg(F.sum("mix_tokens").alias("t")).toPandas()["t"]
    free = source_mix.mix(df, target_entropy=0.9, max_repeats=None, block_tokens=500).groupBy("source").agg(F.sum("mix_tokens").alias("t")).toPandas()["t"]
    p = free / free.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(5) - 0.9) < 0.02 and tokens.sum() < free.sum()
    whole = source_mix.mixed_rows(df.withColumn("block", F.lit("clash")), target_entropy=None, max_repeats=3.0, block_tokens=500)
    assert whole.columns == [*df.columns, "block"]
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(r["doc_id"] for r in got.select("doc_id").collect())
    assert source_mix.mix(empty).count() == 0
    assert source_mix.mix(odd.withColumn("tokens", F.lit("clash"))).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


def _xx(seed, value, kind="<q"):
    import xxhash

    if value is None:
        return seed
    return xxhash.xxh64_intdigest(value.encode() if isinstance(value, str) else struct.pack(kind, value), seed)


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_mix(rows, target_entropy, max_repeats, block_tokens):
    """The whole query for (id, text, source) rows, one source and one row at a time."""
    counted = [(i, s, _signed(_xx(42, t)), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    tokens = {s: sum(c[3] for c in counted if c[1] == s) for s in {c[1] for c in counted}}
    live = {s: n for s, n in tokens.items() if n}

    def meets(a):
        p = np.array([n**a for n in live.values()])
        p /= p.sum()
        return -(p * np.log(p)).sum() <= target_entropy * math.log(max(2, len(live))) + 1e-12 and (min(live.values()) / max(live.values())) ** (a - 1) <= max_repeats + 1e-12

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    alpha = 0.0 if meets(0.0) else high
    z, unit = sum(n**alpha for n in live.values()), max(n ** (1 - alpha) for n in live.values())
    out = []
    for s, n in tokens.items():
        passes = round(n**alpha / z * (z * unit) / n, 6) if n else 1.0
        own = [(i, m, k, _signed(_xx(_xx(_xx(42, "deal"), i), m)) % max(1, -(-n // block_tokens))) for i, q, m, k in counted if q == s]
        for turn in range(max(1, math.ceil(passes - 1e-6))):
            order = {b: _signed(_xx(_xx(_xx(_xx(42, "order"), s), b), turn, "<i")) for b in {o[3] for o in own}}
            left = math.inf if turn < math.floor(passes + 1e-6) else round((passes - math.floor(passes)) * n)
            for b in sorted(order, key=lambda b: (order[b], b)):
                for i, m, k, _ in sorted((o for o in own if o[3] == b), key=lambda o: (_signed(_xx(_xx(_xx(42, o[0]), o[1]), turn, "<i")), o[0], o[1])):
                    if left > 0:
                        out.append((i, s, turn, b))
                    left -= k
    return out


def test_mix_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in docs_of(spark, sf).select("doc_id", "text", "source").collect()]
    got = registry.queries()["op6_source_mix"](spark, sf).collect()
    want = brute_mix(rows, source_mix.TARGET_ENTROPY, source_mix.MAX_REPEATS, source_mix.BLOCK_TOKENS)
    assert sorted((r["doc_id"], r["source"], r["mix_pass"], r["mix_block"]) for r in got) == sorted(want)


def test_mix_many_blocks_and_repeated_ids(spark):
    """Small blocks, so that ranges of blocks and cut blocks matter; ids that rows share."""
    rng = np.random.default_rng(9)
    rows = [(int(i % 300), " ".join(["w"] * int(rng.integers(1, 30)) + [str(i)]), "big" if i < 500 else f"s{i % 3}") for i in range(620)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    want = sorted(brute_mix(rows, 0.97, 3.0, 40))
    got = source_mix.mix(df, target_entropy=0.97, max_repeats=3.0, block_tokens=40).collect()
    assert sorted((r["doc_id"], r["source"], r["mix_pass"], r["mix_block"]) for r in got) == want
    whole = source_mix.mixed_rows(df, target_entropy=0.97, max_repeats=3.0, block_tokens=40).select("doc_id", "source", "text").collect()
    assert sorted((r["doc_id"], r["source"]) for r in whole) == [w[:2] for w in want]
    assert {r["text"] for r in whole} == {t for _, t, _ in rows}


def test_mix_exponent_matches_bisection(spark):
    tokens = [1000.0, 300.0, 50.0, 10.0]
    df = spark.createDataFrame([(str(k), int(t)) for k, t in enumerate(tokens)], "source string, tokens long")
    got = source_mix.find_exponent(df, 0.9, None)
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        p = np.array(tokens) ** mid / (np.array(tokens) ** mid).sum()
        low, high = (mid, high) if -(p * np.log(p)).sum() > 0.9 * np.log(4) else (low, mid)
    assert abs(got - low) < 1e-6


# Tokenizers


HARD = ["", " ", "  ", "\n", "\n\n a", "▁", "a▁b", "\t x", " a  b   c", "日本語 テスト😀", "\x00a", "<s> </s> <unk>", "é́ ﬁ", "\r\n", "    \n   x", "a " * 50, "x" * 300, "it's I'LL", "<|endoftext|>"]


def test_pieces_equal_the_library(spark, sf, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = [(r[0], r[1]) for r in docs_of(spark, sf).select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, None), (20_001, LONG)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in piece_codec.encode_decode(df, piece_codec.default_model(), with_ids=True, with_text=True).collect()}
    for k, t in texts:
        ids = sp.encode(t or "", add_eos=True)
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == sp.decode(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert piece_codec.encode_decode(empty, piece_codec.default_model()).count() == 0


def test_token_counts_equal_a_unigram_tokenizer(spark, sf):
    from tokenizers import Tokenizer, models

    counter = token_counts.TokenCounter.of(piece_codec.default_model())
    v = counter.vocabulary
    sp = v.sp
    vocab = [(sp.id_to_piece(i), sp.get_score(i) if sp.id_to_piece(i) in v.ids else -1e12) for i in range(len(sp))]
    other = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    texts = HARD + [r[0] for r in docs_of(spark, sf).select("text").collect()]
    want = [len(e.ids) for e in other.encode_batch([v.normalise(t or "") for t in texts])]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), piece_codec.default_model())
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == dict(enumerate(want))
    df = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(df, piece_codec.default_model()).collect()) == [0, 0, 2, 2]
    assert token_counts.count_tokens(df.limit(0), piece_codec.default_model()).count() == 0


def test_token_files_round_trip(spark, sf, odd, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    rows = [(r[0], r[1]) for r in docs_of(spark, sf).select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, None), (20_001, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_files.write_token_files(df, str(tmp_path / "t"), token_files.default_tokenizer(), n_files=3)
    got = token_files.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, (k, t) in zip(got, sorted(rows)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (k, start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_files.write_token_files(odd.withColumn("key", F.lit("clash")).withColumn("keys", F.lit(1)), str(tmp_path / "odd"), token_files.default_tokenizer())
    assert token_files.read_token_files(spark, str(tmp_path / "odd")).count() == 10
    token_files.write_token_files(odd.limit(0), str(tmp_path / "none"), token_files.default_tokenizer())
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_caches_stay_within_their_bytes():
    from foliograph.llm._pieces import BoundedCache, Computed

    cache = Computed(10_000, lambda t: t.encode())
    for k in range(1000):
        assert cache[f"text {k}"] == f"text {k}".encode() and cache.held <= 10_000 + 300
    few = BoundedCache(1000)
    assert few.room(["a" * 100]) and few.room(["b"]) and few.update(a=1) is None and not few.room(["c" * 5000]) and not few and few.room(["c" * 5000])
    encoder = token_files.WordEncoder(token_files.default_tokenizer(), 1)
    encoder.words.most = encoder.hard.most = 2000
    texts = [*HARD, "plain words, it's 2 o'clock", "mixed 日本 and plain"] * 3
    assert encoder.by_part and encoder.encode(texts) == [b + encoder.end for b in encoder.by_library(texts)]
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    codec.known.most = 3000
    assert list(codec.encode_batch(texts)) == [codec.vocabulary.sp.encode(t, add_eos=True) for t in texts]


def test_rans_blocks_and_checksums():
    rng = np.random.default_rng(1)
    for n in (0, 1, token_files.LANES - 1, token_files.LANES + 1, token_files.BLOCK + 3):
        ids = (rng.zipf(1.3, n) % 49_000).astype(np.uint32)
        blob = token_files.pack(ids, np.array([n]))
        assert (token_files.unpack(blob)[1] == ids).all()
    last = token_files.unpack(blob, range(1, 2))[1]
    assert (last == ids[token_files.BLOCK :]).all()
    broken = bytearray(blob)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack(bytes(broken))


# Embeddings


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.99, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.1]), (9, []), (None, [1.0, 0.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bytes", F.lit(1))
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert (by[1]["n_links"], by[3]["n_links"], by[2]["component_id"], by[10]["n_links"]) == (3, 3, 1, 0)
    assert (by[8]["n_links"], by[11]["n_links"], by[11]["component_id"]) == (1, 1, 8)
    assert all(by[k]["n_links"] == 0 and by[k]["kept"] for k in (4, 5, 6, 7, 9, None))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_crowded_vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(80, 16)) * 0.18 for c in centers] + [rng.normal(size=(300, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, train=200).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert [got[i] for i in range(len(x))] == links.tolist()


def exact_links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    label = np.arange(len(x))
    while True:
        low = np.where(links, label[None], len(x)).min(axis=1)
        if (low == label).all():
            return links.sum(axis=1) - 1, label
        label = low


@pytest.mark.parametrize("few, block", [(0, 100), (10_000, 2048)])
def test_embeddings_of_several_lengths_in_blocks(spark, monkeypatch, few, block):
    """Lists above a block, and both ways for the lengths; all that brute force links is linked, nothing else."""
    monkeypatch.setattr(embedding_dedup, "FEW", few)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(14)
    sets = []
    for width, n in ((16, 900), (24, 400)):
        centers = rng.normal(size=(30, width))
        near = np.concatenate([c + rng.normal(size=(n // 60, width)) * 0.12 for c in centers])
        sets.append(np.concatenate([near, rng.normal(size=(n - len(near), width))]))
    rows = [(1000 * k + i, v.tolist()) for k, x in enumerate(sets) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), train=400).collect()}
    for k, x in enumerate(sets):
        n, label = exact_links(x)
        assert [got[1000 * k + i]["n_links"] for i in range(len(x))] == n.tolist()
        assert [got[1000 * k + i]["component_id"] for i in range(len(x))] == (1000 * k + label).tolist()


def test_embedding_recall_with_a_fitted_reach(spark):
    """Enough vectors that the reach is taken from the sample: recall against brute force, and fewer lists than the worst case asks for."""
    rng = np.random.default_rng(15)
    base = rng.normal(size=(2600, 32))
    x = np.concatenate([base, base[:500] + rng.normal(size=(500, 32)) * rng.uniform(0.02, 0.33, size=(500, 1))])
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want, _ = exact_links(x)
    found = sum(min(got[i], int(n)) for i, n in enumerate(want))
    assert all(got[i] <= n for i, n in enumerate(want)) and found >= 0.999 * want.sum() > 300
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = embedding_dedup.fit(u, len(u))
    own = (u @ q.centroids.T).argmax(axis=1)
    fitted = q.visits(u, own, math.acos(0.95)).mean()
    q.reach = 1.0
    assert fitted < 0.7 * q.visits(u, own, math.acos(0.95)).mean()


# Pipeline


def test_pipeline_stages(spark, sf, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_dedup", "source_mix", "sentencepiece"]
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "sentencepiece":
                assert out.columns == docs.columns
                docs = minhash_dedup.materialise(out, "test")
        out.collect()
    final = corpus_pipeline.run(spark, sf)
    assert final.count() > 0 and "doc_id" in final.columns


def test_pipeline_run_matches_brute_force(spark):
    """Every stage's decisions by a plain version of it, on all rows."""
    import corpus_pipeline
    import sentencepiece

    sf = "/root/testdata/sf0.01"

    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    left = [r for r in docs.collect() if not brute_toxicity(model, r["text"]) >= toxicity.THRESHOLD]
    assert 0 < len(left) < docs.count()
    df = spark.createDataFrame(left, docs.schema)
    model = language_id.learn(df)
    said = [brute_language(model, r["text"]) for r in left]
    left = [r for r, (lang, score) in zip(left, said) if lang != "und" and score >= corpus_pipeline.LEAST_SHARE]
    groups = reference_components([(r["doc_id"], r["text"]) for r in left], 5, 80, 100)
    alike = len(left)
    left = [r for r in left if groups[r["doc_id"]][1] == r["doc_id"]]
    assert len(left) < alike
    mixed = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in left], source_mix.TARGET_ENTROPY, corpus_pipeline.MAX_REPEATS, source_mix.BLOCK_TOKENS)
    text = {r["doc_id"]: r["text"] for r in left}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    want = sorted((i, hashlib.sha256(" ".join(map(str, sp.encode(text[i], add_eos=True))).encode()).hexdigest()) for i, *_ in mixed)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_keeps_texts_that_share_an_id_and_clashing_columns(spark, sf):
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(1, one, "en", "s", 0), (1, two, "en", "s", 0), (1, two, "en", "s", 0), (0, two, "en", "s", 0), (2, three, "en", "s", 0), (None, one, "en", "s", 0), (None, one, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()
    assert sorted(r["text"][:2] for r in got if r["doc_id"] is not None) == ["a0", "b0", "c0"] and sum(r["doc_id"] is None for r in got) == 2
    clash = df.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit("mine")).withColumn("_key", F.lit(3)).withColumn("row", F.lit(7))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns and {(r["score"], r["predicted"], r["_key"], r["row"]) for r in out.collect()} <= {(0.5, "mine", 3, 7)}
