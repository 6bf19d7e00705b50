"""Operators on small fixtures that the supplied tables don't have: TeX, edits, scores, samples, streams."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.functions import geometry, python_text, scoring
from foliograph.functions import text as T
from foliograph.operators import candidates, edits, graphs, intervals, keysets, lines, multisets, sampling, structure
from foliograph.sources import files

TEX = r"""\chapter{One}
Theorem 2.1. Every \textbf{tree} has a leaf. % a comment
Proof. Take a longest path.
\begin{align}x\end{align}
Theorem 2 shows nothing.
100\% of it \\% rest
\section{Two {nested}}
Lemma (Small). Fine."""


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_mask_keeps_length_and_escaped_marker(spark):
    rows = spark.createDataFrame([(1, TEX)], "doc_id long, text string")
    got = lines.with_masked(lines.explode_lines(rows, offsets=True)).orderBy("line").collect()
    assert all(len(r["masked"]) == len(r["text"]) for r in got)
    assert got[5]["masked"].rstrip() == r"100\% of it \\"
    assert [r["start_off"] for r in got] == [TEX.index(x) if x in TEX else 0 for x in TEX.split("\n")]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab\\%{} ", max_size=12), min_size=1, max_size=8))
def test_masks_never_change_lengths(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", T.mask_comment(F.col("t")).alias("m")).collect():
        assert len(r["m"]) == len(r["t"])
        cut, at = len(r["t"]), 0
        while at < len(r["t"]):
            if r["t"][at] == "\\":
                at += 2
                continue
            if r["t"][at] == "%":
                cut = at
                break
            at += 1
        assert r["m"] == r["t"][:cut] + " " * (len(r["t"]) - cut)


def test_title_candidates_need_evidence(spark):
    rows = spark.createDataFrame([(1, TEX)], "doc_id long, text string")
    got = candidates.title_candidates(lines.with_masked(lines.explode_lines(rows)), candidates.TEX_PACK).orderBy("line").collect()
    assert [(r["kind"], r["line"], r["number"]) for r in got] == [("theorem", 2, "2.1"), ("proof", 3, ""), ("lemma", 8, "")]


def test_titles_are_whole_and_ids_differ(spark):
    long = "Theorem 1. " + "x" * 200
    rows = spark.range(1, 10_002).select(F.lit(1).alias("doc_id"), F.col("id").alias("line"), F.lit(long).alias("masked"))
    got = candidates.title_candidates(rows, candidates.TEX_PACK).agg(F.count_distinct("candidate_id"), F.max(F.length("title")), F.max_by("candidate_id", "line")).first()
    assert tuple(got) == (10_001, len(long), "c-10001")


def test_offsets_of_many_lines(spark):
    """The cost of offsets and of pairing grows with the text: ten times the lines take no hundred times as long."""
    import time

    texts = ["\n".join("ab" * (k % 7) + "é" for k in range(n)) for n in (0, 1, 255, 256, 257, 8_000, 80_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = lines.explode_lines(rows, offsets=True).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start_off").alias("last")).collect()
    assert {r["doc_id"]: (r["n"], r["last"]) for r in got} == {k: (t.count("\n") + 1, t.rfind("\n") + 1) for k, t in enumerate(texts)}
    took = []
    for k in (5, 6):
        began = time.time()
        lines.explode_lines(rows.filter(F.col("doc_id") == k), offsets=True).agg(F.sum("start_off")).collect()
        took.append(time.time() - began)
    assert took[1] < 40 * took[0]
    tags = spark.createDataFrame([(1, "\\begin{a}" * 40_000 + "\\end{a}" * 40_000)], "doc_id long, text string")
    assert structure.pair_tokens(structure.env_tokens(tags), "doc_id").first()["n_pairs"] == 40_000


def test_strict_stack_refuses_crossed_closers(spark):
    text = r"\begin{a}\begin{b}\end{a}\end{b}"
    tokens = structure.env_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = {r["state"]: (r["name"], r["open"], r["close"]) for r in structure.stack_rows(tokens, "doc_id").collect()}
    assert got == {"pair": ("b", 1, 3), "open": ("a", 0, None), "refused": ("a", None, 2)}
    assert tuple(structure.pair_tokens(tokens, "doc_id").first()) == (1, 1, 1, 1)
    assert structure.strict_stack([(0, "v", "open"), (1, "x", "open"), (2, "x", "close"), (3, "v", "close")], frozenset("v")) == ([("v", 0, 3, 0, "")], [], [])
    pairs, left, _ = structure.strict_stack([(0, "o", "open"), (1, "a", "open"), (2, "b", "open"), (3, "b", "close"), (4, "a", "close")])
    assert [p[4] for p in pairs] == ["", "a"] and left == [(0, "o")]


def test_braces(spark):
    assert one(spark, r"{a\}{b}}", "string", structure.brace_balance)["ok"]
    assert tuple(one(spark, "}{", "string", structure.brace_balance)) == (False, -1)
    assert tuple(one(spark, "{{a}", "string", structure.brace_balance)) == (False, 1)
    marks = spark.createDataFrame([(1, k, m) for k, m in enumerate("{}}{")], "d int, pos int, mark string")
    assert tuple(structure.first_negative(marks, "d").first()) == (1, 2, 0)


def test_section_commands_and_verbatim(spark):
    got = one(spark, TEX, "string", python_text.section_commands)
    assert [(s["cmd"], s["title"], s["level"]) for s in got] == [("chapter", "One", 0), ("section", "Two {nested}", 1)]
    assert one(spark, r"a \verb|x%| b \verb+y", "string", python_text.mask_inline_verbatim) == r"a \verb|  | b \verb+y"
    assert [(s["s"], s["e"]) for s in one(spark, r"x \[a\] $$b$$ \[c", "string", python_text.display_spans)] == [(2, 7), (8, 13)]


OPS = "doc_id int, decision string, seq long, kind string, line int, old string, new string"


def numbered(spark, texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id int, line int, text string")


def joined(rows):
    return "".join(r["text"] for r in rows.orderBy("line").collect())


def test_edits_apply_and_revert(spark):
    rows = numbered(spark, "abcdef")
    ops = spark.createDataFrame(
        [(1, "x", 0, "insert", 1, None, "<"), (1, "x", 1, "insert", 3, None, ">"), (1, "y", 2, "replace", 3, "c", "C"), (1, "z", 3, "delete", 5, "e", None), (1, "z", 4, "insert", 6, None, "end"), (1, "z", 5, "insert", 0, None, "top")], OPS
    )
    out = edits.apply_ops(rows, edits.valid_ops(ops, rows, "doc_id"), "doc_id")
    assert joined(out) == "topa<bC>dfend"
    assert joined(edits.apply_ops(out, edits.inverse_ops(rows, ops, "doc_id"), "doc_id")) == "abcdef"
    assert edits.unchanged(rows, ops, "doc_id").first()["ok"]


def test_edits_of_one_line_go_in_order(spark):
    """Deletes, then changes in plan order, then inserts; a prefix is cut by its length, and what is deleted stays deleted."""
    rows = numbered(spark, ["1. one", "two", "three"])
    ops = spark.createDataFrame(
        [(1, "a", 0, "insert", 1, None, "B"), (1, "a", 1, "prefix", 1, "1. ", "* "), (1, "b", 2, "insert", 1, None, "C"), (1, "c", 3, "replace", 2, "two", "TWO"), (1, "d", 4, "prefix", 2, "TW", "x"), (1, "e", 5, "delete", 3, "three", None), (1, "f", 6, "delete", 3, "three", None), (1, "g", 7, "replace", 3, "three", "no")], OPS
    )
    assert joined(edits.apply_ops(rows, ops, "doc_id")) == "* oneBCxO"
    assert edits.unchanged(rows, ops, "doc_id").first()["ok"]


def test_applied_edits_revert_to_the_text(spark):
    """Random operations on many texts, invalid ones among them: what was applied can be undone."""
    rng = random.Random(5)
    lines_, ops = [], []
    for doc in range(120):
        texts = ["".join(rng.choice("ab1. ") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 8))]
        lines_ += [(doc, i + 1, t) for i, t in enumerate(texts)]
        for i in range(rng.randrange(9)):
            kind, line = rng.choice(["insert", "delete", "replace", "prefix"]), rng.randrange(9)
            old = texts[line - 1][:1] if kind == "prefix" and 0 < line <= len(texts) else None
            ops.append((doc, f"d{i}", i, kind, line, old, None if kind == "delete" else f"new{i}"))
    rows = spark.createDataFrame(lines_, "doc_id int, line int, text string")
    got = edits.unchanged(rows, edits.valid_ops(spark.createDataFrame(ops, OPS), rows, "doc_id"), "doc_id").collect()
    assert len(got) == 120 and all(r["ok"] for r in got)


def test_plans_of_all_actions(spark):
    texts = ["Theorem 1. Body", "more", r"\end{note}", "1. first", " 2. second", r"\section*{Trees}", "box", r"\section{Baeume}", "end"]
    rows = numbered(spark, texts)
    kinds = "doc_id int, decision string, seq int, action string, env string, start int, end int, optional_arg string, prefix string, old_end int, new_end int, item_lines array<int>, section_line int, cmd string, title string, translated string, box_start int, box_end int, quiet_qed boolean"
    none = (None,) * 14
    decisions = [
        (1, "w", 0, "wrap", "proof", 1, 2, "x", "Theorem 1. ", *none[:9], True),
        (1, "m", 1, "move-boundary", "note", None, None, None, None, 3, 8, *none[:8]),
        (1, "e", 2, "convert-to-exercise-env", None, None, None, None, None, None, None, [5, 4], *none[:7]),
        (1, "b", 3, "merge-bilingual-title", None, *none[:4], None, None, None, 6, "section", "Trees", "树", 7, 8, None),
        (1, "bad", 4, "move-boundary", "other", None, None, None, None, 3, 8, *none[:8]),
        (1, "odd", 5, "dance", *none, None),
    ]
    ops = edits.plan(spark.createDataFrame(decisions, kinds), "doc_id")
    out = edits.apply_ops(rows, edits.valid_ops(ops, rows, "doc_id"), "doc_id")
    want = [r"\begin{proof}[x]", "Body", "more", edits.QUIET_QED, r"\end{proof}", r"\begin{enumerate}", r"\item first", r"\item second", r"\end{enumerate}", r"\section*{Trees（树）}", r"\addcontentsline{toc}{section}{Trees（树）}", r"\end{note}", "end"]
    assert [r["text"] for r in out.orderBy("line").collect()] == want
    assert {r["decision"]: r["error"] for r in edits.rejected(ops, rows, "doc_id").collect()} == {"bad": "line 3 isn't as expected", "odd": "unknown action"}


def test_one_misfit_drops_the_whole_decision(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, line int, text string")
    ops = spark.createDataFrame(
        [(1, "x", 0, "replace", 1, "a", "A"), (1, "x", 1, "replace", 2, "other", "B"), (1, "y", 2, "delete", 2, "b", None)],
        "doc_id int, decision string, seq long, kind string, line int, old string, new string",
    )
    assert [r["decision"] for r in edits.valid_ops(ops, rows, "doc_id").collect()] == ["y"]


def test_conflicts_drop_both_sides_and_touching_ends_conflict(spark):
    rows = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 5, 6), (1, "c", 7, 9), (1, "d", 0, 0), (2, "e", 1, 9)], "k int, id string, s int, e int")
    assert sorted(r["id"] for r in intervals.conflicts(rows, "k").collect()) == ["a", "b"]
    assert sorted(r["id"] for r in intervals.without_conflicts(rows, "k", ["id"]).collect()) == ["c", "d", "e"]


def test_wilson_and_rates(spark):
    got = spark.createDataFrame([(0, 0), (720, 720), (300, 300), (718, 720)], "k int, n int").select(F.round(scoring.wilson_lower(F.col("k"), F.col("n")), 6).alias("w")).collect()
    assert [r["w"] for r in got] == [0.0, 0.994693, 0.987357, 0.989929]
    p = spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int").select(*[v.alias(k) for k, v in scoring.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()]).first()
    assert (p["precision"], p["recall"], p["f1"]) == (1.0, 1.0, 1.0)
    c = spark.createDataFrame([(0.5,), (None,), (math.nan,), (1.5,)], "c double").select(scoring.valid_confidence(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in c] == [True, False, False, False]


def test_scalar_functions(spark):
    assert one(spark, "xiv", "string", T.roman_or_decimal) == 14 and one(spark, "12", "string", T.roman_or_decimal) == 12 and one(spark, "abc", "string", T.roman_or_decimal) is None
    assert one(spark, "a_b%{", "string", T.escape_tex) == r"a\_b\%\{"
    assert one(spark, "1-3, 5", "string", lambda c: T.page_range(c, F.lit(9))) == [1, 2, 3, 5] and one(spark, "3-1", "string", lambda c: T.page_range(c, F.lit(9))) is None
    assert one(spark, "v1.10", "string", lambda c: T.compare_versions(c, F.lit("1.9.9"))) == 1
    assert one(spark, "../x", "string", T.safe_path) is False and one(spark, "a/b.tex", "string", T.safe_path) is True
    assert one(spark, 'a<b>:"c"?.txt', "string", T.safe_filename) == "a_b_c_.txt"
    assert one(spark, "HTTPS://User@Example.COM.:80/x", "string", T.host) == "example.com"
    assert one(spark, "see Theorem 2.1 and Fig. 3", "string", T.reference_tokens) == ["theorem:2.1", "figure:3"]
    assert len(one(spark, "a b c d", "string", lambda c: multisets.gram_hashes(F.split(c, " ")))) == 1 and len(one(spark, "a b c d e f a b c d e", "string", lambda c: multisets.gram_hashes(F.split(c, " ")))) == 6
    assert {(r["word"], r["n"]) for r in one(spark, "b a b c b a", "string", lambda c: multisets.word_counts(F.split(c, " ")))} == {("a", 2), ("b", 3), ("c", 1)}
    assert one(spark, "ﬁ Ａ!", "string", python_text.nfkc_key) == "fia"
    assert one(spark, r"3.1 \textbf{Élan}", "string", python_text.plain_title) == "elan"
    assert one(spark, "a\r\nb\nc\r\n", "string", T.newline_of) == "CRLF"
    assert one(spark, 'token = "abcdef123456" /home/me/x', "string", lambda c: T.redact_secrets(c)[0]) == "token = [redacted] [path]"
    assert one(spark, "Done", "string", lambda c: T.terminal_status(c, F.lit(False))) == "needs_review"


def test_geometry(spark):
    got = spark.range(1).select(geometry.overlap(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(5.0)).alias("o"), geometry.distance([F.lit(float(x)) for x in (0, 0, 1, 1)], [F.lit(float(x)) for x in (4, 5, 6, 7)]).alias("d")).first()
    assert got["o"] == 0.5 and got["d"] == 5.0


def test_multisets_and_sequences(spark):
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate("aabc")], "k int, p int, t string")
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate("abbd")], "k int, p int, t string")
    got = multisets.multiset_f1(a, b, "k", "t").first()
    assert (got["matched"], got["f1"]) == (2, 0.5)
    assert multisets.first_difference(a, b, "k", "p", "t").first()["first_difference"] == 1
    assert multisets.first_difference(a, a, "k", "p", "t").first()["first_difference"] is None


def test_samples(spark):
    rows = spark.range(100).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("i"))
    assert sorted(r["i"] for r in sampling.evenly_spaced(rows, ["i"], 5, ["g"]).collect()) == [round(k * 99 / 4) for k in range(5)]
    sizes = sampling.balanced_batches(rows, ["g"], ["i"], 7).groupBy("batch").count().collect()
    assert max(r["count"] for r in sizes) <= 7 and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1


def test_includes_closure_and_flatten(spark):
    f = spark.createDataFrame([("main.tex", r"\input{a}\include{b}"), ("a.tex", r"\input{b}"), ("b.tex", r"\input{a.tex}\input{gone}")], "path string, masked string")
    e = graphs.includes(f)
    assert {(r["node"], r["depth"]) for r in graphs.closure(e, "main.tex").collect()} == {("main.tex", 0), ("a.tex", 1), ("b.tex", 1), ("gone.tex", 2)}
    assert {(r["path"], r["target"]) for r in graphs.cycles(e).collect()} == {("a.tex", "b.tex"), ("b.tex", "a.tex")}
    assert [r["target"] for r in graphs.missing(e, f).collect()] == ["gone.tex"]
    assert [r["path"] for r in graphs.flatten(f, e, "main.tex").orderBy("ordinal").collect()] == ["main.tex", "a.tex", "b.tex", "gone.tex"]


def test_closure_of_diamonds_and_deep_trees(spark):
    """Twelve diamonds in a row have 4,096 paths; each node is visited once."""
    edges = [(f"n{k}", f"{side}{k}") for k in range(12) for side in "lr"] + [(f"{side}{k}", f"n{k + 1}") for k in range(12) for side in "lr"]
    got = graphs.closure(spark.createDataFrame(edges, "path string, target string"), "n0")
    assert got.agg(F.count("*"), F.max("depth")).first() == (37, 24)


def test_projects_splice_and_split(spark):
    texts = {"main.tex": "a\n\\input{x} \\input{y}\n% \\input{z}\nb", "x.tex": "x1\n\\input{y}", "y.tex": "y1\n\\input{main}\n\\input{gone}", "z.tex": "never"}
    whole = graphs.splice(texts, "main.tex")
    assert whole.split("\n")[2:4] == [graphs.START + "x.tex", "x1"] and whole.count(graphs.START) == 2 and "never" not in whole
    assert graphs.unsplice(whole, "main.tex") == {k: t for k, t in texts.items() if k != "z.tex"}
    files = spark.createDataFrame([(p, k, t) for p in (1, 2) for k, t in texts.items()], "project int, path string, text string")
    roots = spark.createDataFrame([(1, "main.tex"), (2, "x.tex")], "project int, root string")
    back = graphs.processed(files, roots, lambda d: d.withColumn("text", F.replace("text", F.lit("y1"), F.lit("Y"))))
    got = {(r["project"], r["path"]): (r["text"], r["ok"]) for r in back.collect()}
    assert got[1, "y.tex"] == ("Y\n\\input{main}\n\\input{gone}", True) and {k[1] for k in got if k[0] == 2} == {"x.tex", "y.tex", "main.tex"}


def test_support_files_declare_environments(spark):
    rows = [("main.tex", r"\documentclass[a4paper]{book2}\usepackage{own, amsmath}"), ("book2.cls", r"\LoadClass{book}\newtheorem{thm}{T}"), ("own.sty", r"\newtheorem*{lem}{L}\input{more}"), ("more.tex", r"\newtheorem{rem}[thm]{R}"), ("other.sty", r"\newtheorem{no}{N}")]
    files = spark.createDataFrame(rows, "path string, masked string")
    edges = graphs.support_edges(files)
    assert {r["name"] for r in graphs.declared_environments(files, edges, "main.tex").collect()} == {"thm", "lem", "rem"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "main.tex").write_bytes("﻿hé\r\nb".encode())
    (tmp_path / "x" / "old.tex").write_bytes("caf\xe9".encode("latin-1"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert (got["main.tex"]["text"], got["main.tex"]["bom"], got["main.tex"]["newline"]) == ("hé\r\nb", True, "\r\n")
    assert got["old.tex"]["text"] == "café"
    back = files.read_text_files(spark, str(tmp_path))
    raw = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in files.encoded(back).collect()}
    changed = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in files.encoded(back.withColumn("text", F.concat("text", F.lit("\nz")))).collect()}
    assert changed["main.tex"] == (tmp_path / "main.tex").read_bytes() + b"\r\nz" and changed["old.tex"] == b"caf\xe9\nz"
    assert raw["main.tex"] == (tmp_path / "main.tex").read_bytes() and raw["old.tex"] == b"caf\xe9"
    assert files.main_file(files.read_text_files(spark, str(tmp_path))).first()["path"].endswith("main.tex")


def test_collisions(spark):
    got = keysets.path_collisions(spark.createDataFrame([("A/b",), ("a/B",), ("a",)], "p string"), "p").collect()
    assert sorted((r["p"], r["reason"]) for r in got) == [("a", "folder"), ("a/b", "case")]


def test_price_tiers(spark):
    bands = spark.createDataFrame([("m", 10, 1.0), ("m", None, 2.0)], "model string, max_input_tokens int, rate double")
    use = spark.createDataFrame([("m", 10), ("m", 11), ("x", 1)], "own string, tokens int")
    assert sorted((r["own"], r["tokens"], r["rate"]) for r in intervals.tier_lookup(use, bands, "own", "tokens").collect() if r["rate"]) == [("m", 10, 1.0), ("m", 11, 2.0)]


def test_decoding_is_strict(spark):
    import pytest

    decode = python_text.decode_ladder
    assert decode("中文".encode("gb18030"))[:2] == ("中文", "gbk") and decode("\ufeffé\r".encode("utf-16-le"))[:3] == ("é\r", "utf-16-le", True)
    assert decode(b"%!TeX encoding = latin1\n\xe9")[:2] == ("%!TeX encoding = latin1\né", "latin-1") and decode(b"\xe9\xff")[1] == "latin-1"
    for wrong in (b"\xef\xbb\xbf\xff", b"% coding: utf-8\n\xff", b"% coding: nonsense\n"):
        with pytest.raises(ValueError):
            decode(wrong)
    with pytest.raises(UnicodeEncodeError):
        python_text.encode_like("日", b"\xe9")


def test_title_scores(spark):
    score = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(python_text.title_score(F.col("a"), F.col("b"))).first()[0]
    assert score("", "") == 0.0 and score(r"2.1 \textbf{Élan} $x$", "elan x") == 1.0
    assert score("Introduction", "Introduction to trees") == 0.97 and score("Introduction to trees", "Introduction") == 0.94
    both = spark.createDataFrame([("a b", "A  B"), ("", ""), ("abc", "")], "a string, b string").select(python_text.text_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in both] == [1.0, 1.0, 0.0]


def test_zip_members_are_bounded(spark, tmp_path):
    import zipfile

    import pytest

    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/main.tex", "x")
        z.writestr("b.tex", "y")
    assert {(r["path"], bytes(r["content"])) for r in files.read_zip(spark, str(tmp_path)).collect()} == {("a/main.tex", b"x"), ("b.tex", b"y")}
    for k, (name, text, mode) in enumerate((("../x", "x", zipfile.ZIP_STORED), ("bomb", "0" * 10**6, zipfile.ZIP_DEFLATED))):
        (tmp_path / f"bad{k}").mkdir()
        with zipfile.ZipFile(tmp_path / f"bad{k}" / "bad.zip", "w", mode) as z:
            z.writestr(name, text)
        with pytest.raises(Exception, match="unsafe|too much"):
            files.read_zip(spark, str(tmp_path / f"bad{k}")).collect()


def test_sinks_repeat_without_doubling(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False)], "id int, text string, ok boolean")
    for _ in range(2):
        kept = files.store_blobs(rows, "text", str(tmp_path / "blobs"))
        fine = files.quarantine(rows, "ok", str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2 and kept.columns == ["id", "ok", "sha256"]
    assert fine.count() == 1 and files.read_quarantine(spark, str(tmp_path / "bad")).count() == 2
    files.write_csv(rows.withColumn("title", F.col("text")), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == ",".join(files.ISSUE_COLUMNS)
    (tmp_path / "packs").mkdir()
    for name in ("b", "a"):
        (tmp_path / "packs" / f"{name}.json").write_text("{}")
    assert [r["name"] for r in files.pack_names(spark, str(tmp_path / "packs")).collect()] == ["a", "b"]


def test_gold_labels_find_their_line(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"name":"g","sample":"s","pack":"p","mode":"rule","compile":false,"labels":[{"needle":"Theorem","kind":"theorem-like","env":"theorem","line":2},{"needle":"Proof","kind":"proof"},{"needle":"no","kind":"proof"}]}')
    samples = spark.createDataFrame([("s", "Theorem\nTheorem\nProof")], "sample string, text string")
    assert [r["found_line"] for r in files.read_gold(spark, str(tmp_path), samples).orderBy("n").collect()] == [2, 3, None]


def test_positions_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"), (F.col("id") * 7919 % 3000).alias("i")).repartition(5)
    got = sampling.positions(rows, ["g"], ["i"]).collect()
    for g in ("hot", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])
        assert [r["position"] for r in own] == list(range(1, len(own) + 1)) and {r["total"] for r in own} == {len(own)}
    sizes = sampling.even_batches(rows.filter("g IS NULL").limit(9), ["g"], ["i"]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3]
