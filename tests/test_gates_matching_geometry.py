"""Verification gates, ordered matching and page geometry on small fixtures."""

from pyspark.sql import functions as F

from foliograph.functions import python_text
from foliograph.operators import gates, geometry, matching


def test_gates_accept_or_restore(spark):
    """A legal wrap passes every check, braces too; what changes a formula's body, loses a label or comes from a comment is told."""
    good = (1, "\\label{a} $x$ \\[y\\] {b}", "\\begin{theorem}\n\\label{a} $x$ \\[y\\] {b}\n\\end{theorem}")
    lost = (2, r"\label{a} \cite{k} $x$ $x$ /home/me/f", r"\label{b} $x$")
    body = (3, r"\begin{equation}a=b\end{equation}", r"\begin{equation}a=c\end{equation}")
    comment = (4, "% $x$ \\label{z}\ntext", "text")
    crossed = (5, r"\begin{a}x\end{a}", r"\begin{b}\begin{a}x\end{b}\end{a}")
    broken = (6, "{", "{ x")
    pairs = spark.createDataFrame([good, lost, body, comment, crossed, broken], "doc_id int, before string, after string")
    checks = gates.check_edits(pairs)
    by = {(r["doc_id"], r["check"]): r for r in checks.collect()}
    assert all(r["ok"] for k, r in by.items() if k[0] in (1, 4, 6)[:2])
    assert by[2, "labels"]["missing"] == ["a"] and by[2, "labels"]["extra"] == ["b"] and by[2, "math"]["missing"] == ["x"] and by[2, "cites"]["missing"] == ["k"]
    assert (by[3, "math"]["missing"], by[3, "math"]["extra"]) == (["a=b"], ["a=c"]) and not by[5, "environments"]["ok"] and by[6, "braces"]["ok"]
    kept = {r["doc_id"]: r for r in gates.accept_or_restore(pairs, checks).collect()}
    assert kept[1]["text"] == good[2] and kept[2]["text"] == lost[1] and kept[3]["text"] == body[1] and not kept[2]["accepted"]
    final = {r["doc_id"]: r for r in gates.final_gate(checks).collect()}
    assert final[1]["accepted"] and final[2]["failed"] == ["math", "labels", "cites"] and "compile" in final[1]["skipped"]
    assert {r["check"] for r in gates.failures(checks).filter("doc_id = 2").collect()} == {"labels", "cites", "math"}


def test_display_issues(spark):
    text = "\\[ a \\[ b \\] c \\] \\begin{theorem} \\[ x \\tag{1} \\end{theorem} \\]  \\\\[2pt] \\["
    rows = spark.createDataFrame([(1, text), (2, "\\[a\\]")], "doc_id int, masked string")
    got = gates.display_issues(rows, "doc_id").orderBy("pos").collect()
    assert [r["issue"] for r in got] == ["opened twice", "closed without an opener", "tag inside", "environment ends inside", "left open"] and {r["doc_id"] for r in got} == {1}


def test_stamps(spark):
    row = spark.createDataFrame([("body\n",)], "t string").select(gates.stamp(F.col("t"), {"b": "2", "a": "1"}).alias("s"))
    twice = row.select(gates.stamp(F.col("s"), {"c": "3"}).alias("s"), gates.read_stamp(F.col("s")).alias("m"), gates.strip_stamp(F.col("s")).alias("t")).first()
    assert twice["s"] == "% provenance c: 3\nbody\n" and twice["m"] == {"a": "1", "b": "2"} and twice["t"] == "body\n"


def test_missing_images(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b.png"), (1, "c")], "doc_id int, path string")
    there = spark.createDataFrame([("a.pdf",), ("b.png",)], "path string")
    assert [r["path"] for r in gates.missing_images(refs, there, [".pdf", ".png"]).collect()] == ["c"]


def test_outlines(spark):
    want = spark.createDataFrame([(1, 0, "intro", 1, 0), (1, 1, "intro", 1, 1), (1, 2, "end", 9, 0)], "doc_id int, n int, title_key string, page int, level int")
    found = spark.createDataFrame([(1, 10, "intro", 2, 0), (1, 20, "intro", 1, 0), (1, 30, "end", 3, 0)], "doc_id int, line int, title_key string, page int, level int")
    got = {r["n"]: r["line"] for r in matching.greedy_outline(want, found, "doc_id").collect()}
    assert got == {0: 20, 1: 10, 2: None}
    walked = {r["n"]: (r["line"], r["level_ok"]) for r in matching.ordered_outline(want, found, "doc_id").collect()}
    assert walked == {0: (10, True), 1: (20, False), 2: (30, True)}
    assert [r["n"] for r in matching.level_jumps(spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1)], "d int, n int, level int"), "d", "n", "level").collect()] == [1]


def test_fuzzy_titles_and_alignment(spark):
    left = spark.createDataFrame([(1, 1, "introduction to trees")], "page int, left_id int, a string")
    right = spark.createDataFrame([(1, 7, "introduction to trees"), (1, 8, "introduction to"), (1, 9, "graphs")], "page int, right_id int, b string")
    got = matching.fuzzy_titles(left, right, ["page"], python_text.title_score(F.col("a"), F.col("b"))).collect()
    assert [(r["right_id"], r["score"], r["unique"]) for r in got] == [(7, 1.0, False)]
    rows = matching.aligned(spark.createDataFrame([(1, list("abcd"), list("bacd"))], "k int, left array<string>, right array<string>"), "k")
    rate = matching.alignment_rates(rows, ["k"]).first()
    assert (rate["bag_f1"], rate["ordered_f1"], rate["score"]) == (1.0, 0.75, 0.75)


SPANS = "page int, block int, line int, span int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"


def test_runs_displays_and_regions(spark):
    rows = [(1, 0, 0, 0, "x+y", "CMMI", 10.0, 0.0, 0.0, 10.0, 5.0), (1, 0, 0, 1, "=z", "CMMI", 10.0, 11.0, 0.0, 20.0, 5.0), (1, 0, 0, 2, "w", "CMMI", 10.0, 60.0, 0.0, 65.0, 5.0), (1, 0, 1, 0, "long plain text here", "Times", 10.0, 0.0, 10.0, 90.0, 15.0)]
    spans = spark.createDataFrame(rows, SPANS)
    math = F.col("font") == "CMMI"
    runs = geometry.span_runs(spans, ["page"], math, 5.0).orderBy("x0")
    assert [(r["text"], r["n_spans"], r["x1"]) for r in runs.collect()] == [("x+y=z", 2, 20.0), ("w", 1, 65.0)]
    assert {r["line"]: r["display"] for r in geometry.display_lines(spans, ["page"], math).collect()} == {0: True, 1: False}
    merged = geometry.merge_regions(runs.select("page", "x0", "y0", "x1", "y1"), ["page"], 50.0).collect()
    assert [(r["x0"], r["x1"]) for r in merged] == [(0.0, 65.0)]
    assert {r["font"]: r["pages"] for r in geometry.font_inventory(spans).collect()} == {"CMMI": [1], "Times": [1]}


def test_tags_footnotes_and_frames(spark):
    words = spark.createDataFrame([(1, "(2.1)", 90.0, 0.0, 98.0, 5.0), (1, "(3)", 2.0, 0.0, 8.0, 5.0), (2, "(4)", 88.0, 0.0, 95.0, 5.0), (2, "(5)", 40.0, 0.0, 50.0, 5.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    widths = spark.createDataFrame([(1, 100.0), (2, 100.0)], "page int, width double")
    got = {(r["page"], r["label"]): (r["side"], r["uniform"]) for r in geometry.equation_tags(words, ["page"], widths).collect()}
    assert got == {(1, "2.1"): ("right", False), (1, "3"): ("left", False), (2, "4"): ("right", True)}
    spans = spark.createDataFrame([(1, 0, 0, 0, "body text long", "T", 10.0, 0.0, 10.0, 50.0, 20.0), (1, 1, 0, 0, "note", "T", 7.0, 0.0, 92.0, 20.0, 97.0), (1, 2, 0, 0, "end", "T", 10.0, 0.0, 95.0, 20.0, 99.0)], SPANS)
    rules = spark.createDataFrame([(1, 90.0)], "page int, y0 double")
    heights = spark.createDataFrame([(1, 100.0)], "page int, height double")
    assert [r["text"] for r in geometry.footnotes(spans, ["page"], heights, rules).collect()] == ["note"]
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 50.0), (1, 10.0, 10.0, 60.0, 40.0), (1, 0.0, 60.0, 5.0, 70.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert [r["x1"] for r in geometry.framed_regions(boxes, ["page"], 20.0, 20.0).collect()] == [100.0]


def test_page_fidelity_and_chapters(spark):
    source = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "x")], "page int, text string")
    made = spark.createDataFrame([(11, "abc"), (12, "abe")], "page int, text string")
    pages = geometry.page_fidelity(source, made, 10, python_text.sequence_ratio(F.col("text"), F.col("generated_text")))
    chapters = spark.createDataFrame([(1, 1), (2, 3)], "number int, start_page int")
    got = {r["number"]: (round(r["mean"], 4) if r["mean"] else r["mean"], r["n_pages"]) for r in geometry.chapter_means(pages, chapters, 3).collect()}
    assert got == {1: (0.8333, 2), 2: (None, 1)}
