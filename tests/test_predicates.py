"""Predicates, decisions, workflow states, inventories and TeX rows on small fixtures."""

from pyspark.sql import functions as F

from foliograph.functions import python_text, tex
from foliograph.functions import text as T
from foliograph.operators import candidates, edits, gates, inventory, jobs, lines, predicates, templates, workflow
from foliograph.operators import tex as tex_rows
from foliograph.sources import files

SOURCE = r"""\documentclass{book} % class
\usepackage{x}

\begin{document}
\section{One $a{b}$ two}
Theorem 1. First
line.

\[ x
 = y \]
text % \begin{gone}
% only a comment
more \verb|\x{no}| here
\begin{verbatim}
\begin{theorem} literal \]
\end{verbatim}
\begin{quote}
inside
\begin{itemize}
\item a
\end{itemize}
\end{quote}
\subsection{Deep}
last
\end{document}
\end{stray}"""


def test_blocks_of_a_source(spark):
    rows = spark.createDataFrame([(1, SOURCE), (2, ""), (3, None)], "doc_id int, text string")
    got = [(r["kind"], r["name"], r["start_line"], r["end_line"], r["in_env"], r["section_path"]) for r in tex_rows.rows(rows, "blocks").filter("doc_id = 1").orderBy("block_id").collect()]
    one, deep = ["One $a{b}$ two"], ["One $a{b}$ two", "Deep"]
    assert got == [
        ("preamble", "", 1, 2, [], []),
        ("env", "document", 4, 25, [], []),
        ("para", "", 5, 7, [], one),
        ("displaymath", "", 9, 10, [], one),
        ("para", "", 11, 11, [], one),
        ("para", "", 13, 13, [], one),
        ("verbatim", "verbatim", 14, 16, ["verbatim"], one),
        ("env", "verbatim", 14, 16, ["verbatim"], one),
        ("env", "quote", 17, 22, ["quote"], one),
        ("para", "", 18, 18, ["quote"], one),
        ("env", "itemize", 19, 21, ["quote", "itemize"], one),
        ("para", "", 20, 20, ["quote", "itemize"], one),
        ("para", "", 23, 24, [], deep),
        ("para", "", 26, 26, [], deep),
    ]
    assert [tuple(r)[1:] for r in tex_rows.rows(rows, "unbalanced").collect()] == [("stray", 26, "refused")]
    assert [(r["title"], r["level"], r["line"], r["parent"]) for r in tex_rows.rows(rows, "sections").orderBy("n").collect()] == [("One $a{b}$ two", 1, 5, None), ("Deep", 2, 23, 0)]
    assert [(r["start_line"], r["end_line"]) for r in tex_rows.rows(rows, "displays").collect()] == [(9, 10)]
    masked = tex.masked(SOURCE)
    assert len(masked) == len(SOURCE) and masked.count("\n") == SOURCE.count("\n") and "gone" not in masked and "literal" not in masked and r"\verb|      | here" in masked


def test_texts_of_many_lines_are_read_in_proportion(spark):
    import time

    took = []
    for n in (4_000, 40_000):
        text = "\n".join([r"\begin{a}", "x % c", "", r"\[ y \]", r"\end{a}"] * n)
        began = time.time()
        assert len(tex.blocks(text, tex.masked(text), tex.environments(tex.without_comments(text))[0], tex.displays(text))) == 3 * n
        took.append(time.time() - began)
    assert took[1] < 40 * took[0]


def test_extension_and_safe_ends(spark):
    blocks = spark.createDataFrame([(1, 0, "para", 1, 1, "T"), (1, 1, "env", 3, 6, "e"), (1, 2, "para", 4, 5, "inner"), (1, 3, "para", 8, 8, "x"), (1, 4, "para", 10, 10, "Y"), (1, 5, "para", 12, 12, "T2"), (1, 6, "para", 14, 14, "q")], "doc_id int, block_id int, kind string, start_line int, end_line int, text string")
    begins = F.col("text").startswith("T")
    got = tex_rows.extended(blocks, "doc_id", begins, begins, F.col("kind") == "env", F.lit(True) & ~begins, F.lit(True)).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in got] == [(1, 6), (12, 14)]
    ended = tex_rows.extended(blocks, "doc_id", begins, begins, F.lit(True), ~begins, F.lit(False), F.col("text") == "x").orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in ended] == [(1, 8), (12, 14)]
    rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(["Proof.", "a", "", "b", "", "Theorem", "Proof", "c", "done □", "", "d"])], "doc_id int, line int, text string")
    plain = spark.createDataFrame([(1, "para", 1, 2), (1, "para", 4, 4), (1, "para", 6, 6), (1, "para", 7, 9), (1, "para", 11, 11)], "doc_id int, kind string, start_line int, end_line int")
    halts = spark.createDataFrame([(1, 6)], "doc_id int, start_line int")
    asked = spark.createDataFrame([(1, "reaches", 1, 5), (1, "short", 1, 2), (1, "over", 1, 9), (1, "sign", 7, 7), (1, "open", 11, 11)], "doc_id int, id string, start int, requested int")
    ends = tex_rows.safe_ends(asked, rows, plain, halts, "doc_id", "id", F.col("text").contains("□"))
    assert {r["id"]: r["safe_end"] for r in ends.collect()} == {"reaches": 4, "short": None, "over": 4, "sign": 9, "open": None}
    wraps = asked.select("doc_id", "id", "start", F.col("requested").alias("end"))
    assert {r["id"]: (r["end"], r["error"] is None) for r in predicates.legalised(wraps, ends, "doc_id", "id").collect()}["over"] == (4, True)


def test_decisions_are_held_against_their_candidates(spark):
    own = spark.createDataFrame([("a", 3), ("b", 5), ("c", 7), ("d", 9)], "id string, line int")
    said = [("a", "wrap", "proof", 3, 4, 0.9), ("b", "wrap", "odd", 5, 6, 0.9), ("c", "wrap", "proof", 8, 9, 0.9), ("d", "none", None, None, None, float("nan")), ("x", "none", None, None, None, 0.5), ("a2", "none", None, None, None, 0.5)]
    rows = spark.createDataFrame(said, "id string, action string, env string, start int, end int, confidence double")
    got = {r["id"]: r["error"] for r in predicates.decisions_fit(rows, own, ["id"], ["proof"]).collect()}
    assert got == {"a": None, "b": "unknown environment", "c": "no range", "d": "no confidence", "x": "unknown candidate", "a2": "unknown candidate"}


def test_text_predicates(spark):
    one = lambda text, column: spark.createDataFrame([(text,)], "v string").select(column(F.col("v"))).first()[0]
    assert tuple(one(r"\textbf{Theorem 1}", predicates.semantic_view)) == ("Theorem 1", True)
    assert one(r"\label{a}\begin{x}[o] }", lambda c: predicates.only_title(c, F.lit(False))) and not one("text", lambda c: predicates.only_title(c, F.lit(False)))
    assert one("The statement of it was left outside the environment.", predicates.outside_evidence) and not one("left outside", predicates.outside_evidence)
    assert one(r"So it holds \]", predicates.closed_statement) and one("It holds.}", predicates.closed_statement) and not one("It holds if", predicates.closed_statement)
    assert one("Contents", predicates.line_kind) == "generic" and one("Trees . . . . 12", predicates.line_kind) == "contents row"
    assert one("iiii", T.roman_or_decimal) is None and one("MCMXC", T.roman_or_decimal) == 1990
    assert candidates.has_end_marker(F.lit("x"), candidates.TEX_PACK) is not None and one(r"so \qed", lambda c: candidates.has_end_marker(c, candidates.TEX_PACK))
    assert one("pаge", T.confusables) == ["а"]
    assert [r["op"] for r in one("a\nb", lambda c: python_text.line_diff(c, F.lit("a\nc")))] == ["equal", "replace"]


def test_candidates_in_sections(spark, tmp_path):
    sections = spark.createDataFrame([(1, 1, 9, "Exercises"), (1, 10, 20, "Trees")], "doc_id int, start_line int, end_line int, title string")
    items = spark.createDataFrame([(1, 2, "1. a"), (1, 4, " 2. b"), (1, 6, "no"), (1, 12, "1. c"), (1, 13, "2. d")], "doc_id int, line int, text string")
    assert [(r["title"], r["n_items"]) for r in candidates.exercise_sections(sections, items, candidates.TEX_PACK).collect()] == [("Exercises", 2)]
    (tmp_path / "own.json").write_text('{"name": "own", "proof_starts": null, "end_markers": [], "exercise_keywords": ["tasks"]}')
    pack = candidates.load_pack(spark, str(tmp_path / "own.json"))
    assert pack.name == "own" and pack.exercise_keywords == ["tasks"] and pack.proof_starts == candidates.TEX_PACK.proof_starts
    ops = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "doc_id int, seq int, ok boolean")
    assert [r["doc_id"] for r in edits.all_or_nothing(ops, F.col("ok"), "doc_id").collect()] == [2]
    before, after = (spark.createDataFrame(rows, "path string, text string") for rows in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert sorted(r["path"] for r in files.changed_files(before, after).collect()) == ["b", "c"]


def test_states_and_reviews(spark):
    events = spark.createDataFrame([(1, 1, "go"), (1, 2, "commit"), (1, 3, "cancel"), (1, 4, "end"), (2, 1, "cancel"), (2, 2, "end")], "job int, t int, kind string")
    got = jobs.accepted_events(events, "job", "t", "t", F.col("kind") == "commit", F.col("kind") == "cancel").orderBy("job", "t").collect()
    assert [(r["job"], r["kind"]) for r in got] == [(1, "go"), (1, "commit"), (1, "end"), (2, "cancel")]
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    reviews = spark.createDataFrame([("a", 1, "reject"), ("b", 1, "reject"), (None, 2, "reset"), ("b", 3, "reject")], "id string, t int, action string")
    assert {r["id"]: r["excluded"] for r in workflow.after_reviews(items, reviews, "id", "t", "t").collect()} == {"a": False, "b": True, "c": False}


def test_inventories(spark):
    rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(["text", "References", "[1] One", "goes on", "", "[2] Two", ""])], "doc_id int, line int, text string")
    assert [(r["number"], r["start_line"], r["end_line"], r["ok"]) for r in inventory.bibliography(rows, "doc_id").orderBy("number").collect()] == [(1, 3, 4, True), (2, 6, 6, True)]
    shown = spark.createDataFrame([(1, "\\[\n(2.1) x\n\\]"), (2, "\\[ x \\tag{3} (4) \\]"), (3, "$$x$$")], "n int, text string")
    got = {r["n"]: (r["representation"], r["label"], r["rewritable"]) for r in inventory.equations(shown, "n").collect()}
    assert got == {1: ("prefix", "2.1", True), 2: ("tag", "3", False), 3: ("none", "", False)}
    ends = spark.createDataFrame([(1, 1, "the infor-"), (1, 2, "mation"), (1, 3, "well-"), (1, 4, "known"), (1, 5, "odd-"), (1, 6, "ity")], "doc_id int, line int, text string")
    lexicon = spark.createDataFrame([("information", 3), ("well-known", 2), ("oddity", 1)], "word string, n int")
    assert [r["verdict"] for r in inventory.line_ends(ends, lexicon, "doc_id").orderBy("line").collect()] == ["JOIN", "KEEP", "AMBIGUOUS"]
    assert lines.merge_pages(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "d int, page int, text string"), "d", "page", "text").first()["text"].startswith("%% page 1\na")


def test_visible_text_and_style_revisions(spark):
    source = r"\section{A \'{e}t\'e} \textbf{bold  x}~y $a_b$ 5\% \label{z} \[ d \] \v{c}"
    pieces = tex.visible(source)
    assert "".join(p for p, _ in pieces) == f"A été bold x y {tex.SENTINEL} 5% {tex.SENTINEL} č"
    assert all(0 <= at < len(source) for _, at in pieces) and dict((p, source[at]) for p, at in pieces)["bold"] == "b"
    pairs = spark.createDataFrame([(1, "a b", r"\textbf{a} b"), (2, "a b", "a c"), (3, r"a \label{x}", "a")], "doc_id int, before string, after string")
    assert {r["doc_id"]: r["ok"] for r in gates.style_revision(pairs).collect()} == {1: True, 2: False, 3: False}


def test_structure_checks_and_contents(spark):
    docs = spark.createDataFrame([(1, "\\section{a}\n\\subsubsection{b}\n\\section{a}\n\\begin{x}"), (2, "\\section{a}")], "doc_id int, text string")
    assert {(r["doc_id"], r["check"], r["n"]) for r in gates.structure_check(docs).collect()} == {(1, "environments", 1), (1, "levels", 1), (1, "repeats", 1)}
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([r"\section*{Contents}", "One . . . . 1", "Two ..... 7", "Three .... 9", "text", "Contents", "One ... 1"])], "d int, line int, text string")
    assert [(r["line"], r["n_rows"]) for r in predicates.contents_regions(rows, "d", "line", "text").collect()] == [(0, 4)]
    assert spark.createDataFrame([("%% page 1\na\n%% page 2\nb",)], "t string").select(predicates.ocr_document(F.col("t"))).first()[0]


def test_models_and_reviewers_are_checked(spark):
    own = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (1, "c", 7)], "doc_id int, id string, line int")

    def model(row):
        if row["id"] == "c":
            raise ValueError("no answer")
        return {"action": "wrap", "env": "proof" if row["id"] == "a" else "odd", "start": row["line"], "end": row["line"] + 1, "confidence": 0.9}

    said = templates.decided(own, model, ["doc_id", "id"], ["proof"])
    assert {r["id"]: r["error"] for r in said.collect()} == {"a": None, "b": "unknown environment", "c": "unknown action"}
    calls = []

    def reviewer(now):
        calls.append(1)
        return now.filter("end < 6").select("doc_id", "id", F.when(F.col("id") == "b", "reject").otherwise("move").alias("verdict"), (F.col("end") + 1).alias("end"))

    rows = spark.createDataFrame([(1, "a", 3, 4), (1, "b", 5, 5), (1, "c", 7, 8)], "doc_id int, id string, start int, end int")
    assert {r["id"]: r["end"] for r in templates.reviewed(rows, reviewer, ["doc_id", "id"]).collect()} == {"a": 6, "c": 8} and len(calls) == 2


def test_results_commit_together(spark, tmp_path):
    import pytest

    part = lambda text: {n: spark.createDataFrame([(f"{n} {text}",)], "t string") for n in files.RESULT_PARTS}
    files.commit_results(part("one"), str(tmp_path / "p"))
    broken = part("two") | {"verification": spark.createDataFrame([(1,)], "x int").select(F.raise_error(F.lit("lost")).alias("t"))}
    with pytest.raises(Exception, match="lost"):
        files.commit_results(broken, str(tmp_path / "p"))
    assert files.read_results(spark, str(tmp_path / "p"))["result"].first()["t"] == "result one"
    files.commit_results(part("three"), str(tmp_path / "p"))
    assert {d.first()["t"] for d in files.read_results(spark, str(tmp_path / "p")).values()} == {f"{n} three" for n in files.RESULT_PARTS}


def test_manifests_and_folders(spark, tmp_path):
    import pytest

    good = '{"id": "a", "source_sha256": "%s", "threshold": 0.9, "page_offset": 2, "chapters": [{"number": 1, "title": "x", "start_page": 3}, {"number": 2, "title": "y", "start_page": 9}]}' % ("A" * 64)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(good)
    (tmp_path / "m" / "b.json").write_text('{"id": "b", "source_sha256": "12", "threshold": 2.0, "chapters": [{"number": 1, "title": "x", "start_page": 3}, {"number": 3, "title": "y", "start_page": 3}]}')
    got = {r["id"]: r["errors"] for r in files.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert got == {"a": [], "b": ["source_sha256", "threshold", "chapters"]}
    (tmp_path / "f" / "x").mkdir(parents=True)
    (tmp_path / "f" / "main.tex").write_text("a")
    (tmp_path / "f" / "x" / "b.tex").write_text("b")
    assert sorted(r["path"] for r in files.read_folder(spark, str(tmp_path / "f")).collect()) == ["main.tex", "x/b.tex"]
    with pytest.raises(ValueError, match="too much"):
        files.read_folder(spark, str(tmp_path / "f"), most_files=1)
