"""Predicates and small windows over lines, titles and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Style commands around a title, and commands that stand in front of it without being text; fixed by TeX.
STYLES, LEADS = "textbf|textit|emph", "noindent|leavevmode"
#: Commands without content of their own; fixed by TeX.
EMPTY = r"\\label\s*\{[^{}]*\}|\\(?:noindent|leavevmode|par|vspace\*?\{[^{}]*\}|index\{[^{}]*\})|\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]]*\])?|[{}\s]"
#: Titles that say nothing of a document.
GENERIC = ["contents", "index", "notes", "preface", "chapter"]


def semantic_view(first: Column) -> Column:
    """Struct of a line's text without one style command around all of it, and whether there was one."""
    inner = F.regexp_extract(first, rf"^\s*\\(?:{STYLES})\{{(.*)\}}\s*$", 1)
    text = F.when(inner != "", inner).otherwise(first)
    return F.struct(F.regexp_replace(text, rf"^\s*\\(?:{LEADS})\b\s*", "").alias("text"), (inner != "").alias("styled"))


def only_title(body: Column, has_title: Column) -> Column:
    """Whether nothing is left of a body without commands that have no content, or only what is its title."""
    return (F.regexp_replace(body, EMPTY, "") == "") | has_title


def line_kind(text: Column) -> Column:
    """generic, contents row (a title, dots, a page), no letters, or text."""
    dotted = r"^.*\S\s*(?:\.\s?){3,}\s*[0-9]+$"
    return F.when(F.lower(text).isin(GENERIC), "generic").when(text.rlike(dotted), "contents row").when(text.rlike("^[^a-zA-Z]*$"), "no letters").otherwise("text")


def since_marker(rows: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """``since``: how far each row lies behind the last marker, its own included; null in front of the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("since", F.col(order) - F.last(F.when(marker, F.col(order)), ignorenulls=True).over(w))


def heading_runs(rows: DataFrame, by: list[str], order: str, is_heading: Column, least: int = 2, most: int = 3) -> DataFrame:
    """by, s and e of runs of ``least`` to ``most`` neighbouring heading lines."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.filter(is_heading).withColumn("_g", F.col(order) - F.row_number().over(w))
    runs = marked.groupBy(*by, "_g").agg(F.min(order).alias("s"), F.max(order).alias("e"), F.count("*").alias("_n"))
    return runs.filter(F.col("_n").between(least, most)).drop("_g", "_n")


def signature_matches(expected: DataFrame, found: DataFrame, by: list[str], ident: str) -> DataFrame:
    """by, expected, matched (found and active) and missing of evidence ids."""
    both = expected.join(found.select(*by, ident, "active"), [*by, ident], "left")
    return both.groupBy(*by).agg(F.count("*").alias("expected"), F.count_if(F.coalesce("active", F.lit(False))).alias("matched"), F.count_if(F.col("active").isNull()).alias("missing"))


def outside_evidence(text: Column, phrase: str = r"left\s+outside(?:\s+of)?\s+(?:the|its)\s+environment", gap: int = 200) -> Column:
    """Whether a paragraph says that a statement was left outside of its environment, within ``gap`` characters of its name."""
    return text.rlike(rf"(?is)(?:statement|body|proof|text).{{0,{gap}}}?{phrase}")


def closed_statement(text: Column) -> Column:
    """Whether a statement ends like one: a full stop, question or exclamation mark, a closed display or an end sign behind it."""
    return text.rlike(r"(?s)(?:[.!?。？！]|\\\]|\$\$|\\end\s*\{(?:equation|align|gather|enumerate|itemize)\*?\}|\\qed|□)\s*[}\])]*\s*$")


def decisions_fit(decisions: DataFrame, candidates: DataFrame, key: list[str], envs: list[str]) -> DataFrame:
    """Replies of a decision model with ``error``: one reply for each known candidate, a known action and environment, an ordered range that
    begins at the candidate's line, and a confidence from 0 to 1. Null errors fit."""
    n = F.count("*").over(Window.partitionBy(*key))
    rows = decisions.withColumn("_n", n).join(candidates.select(*key, F.col("line").alias("_line")), key, "left")
    confidence = F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0)
    error = (
        F.when(F.col("_line").isNull(), "unknown candidate").when(F.col("_n") > 1, "more than one reply").when(~F.coalesce(F.col("action").isin("wrap", "none"), F.lit(False)), "unknown action")
        .when(~F.coalesce(confidence, F.lit(False)), "no confidence").when((F.col("action") == "wrap") & ~F.coalesce(F.col("env").isin(envs), F.lit(False)), "unknown environment")
        .when((F.col("action") == "wrap") & ~F.coalesce((F.col("start") == F.col("_line")) & (F.col("start") <= F.col("end")), F.lit(False)), "no range")
    )
    return rows.withColumn("error", error).drop("_n", "_line")


def legalised(decisions: DataFrame, ends: DataFrame, key: str, ident: str) -> DataFrame:
    """Wraps with their end moved to the one that can be shown (key, ident, safe_end), and ``error`` where none can."""
    rows = decisions.join(ends.select(key, ident, "safe_end"), [key, ident], "left")
    return rows.withColumn("end", F.coalesce("safe_end", "end")).withColumn("error", F.when(F.col("safe_end").isNull(), "no end can be shown")).drop("safe_end")


def outline_noise(entries: DataFrame, by: list[str], title: str) -> DataFrame:
    """Outline entries with ``noise``: a generic title on a page that has another, real title. A window over the page, no self join."""
    generic = F.lower(F.trim(title)).isin(GENERIC)
    real = F.max((~generic).cast("int")).over(Window.partitionBy(*by))
    return entries.withColumn("noise", generic & (real == 1))


def contents_regions(lines: DataFrame, key: str, line: str, text: str, reach: int = 60, least: int = 3) -> DataFrame:
    """Lines with a heading of contents behind which, in at most ``reach`` lines, at least ``least`` typed rows of a table of contents stand."""
    heading = F.lower(F.regexp_replace(text, r"^\s*(?:\\(?:chapter|section)\*?\{)?|\}?\s*$", "")) == "contents"
    ahead = F.sum((line_kind(F.col(text)) == "contents row").cast("int")).over(Window.partitionBy(key).orderBy(line).rowsBetween(1, reach))
    return lines.withColumn("_n", ahead).filter(heading & (F.col("_n") >= least)).select(key, line, F.col("_n").alias("n_rows"))


def proof_metadata(first: Column) -> Column:
    """Struct of a proof's heading: the kind (bracket, sketch, of, plain; null for others), what it is a proof of, and the text behind it."""
    line = semantic_view(first)["text"]
    bracket = r"^(?i:proof)\s*[(\[]([^)\]]*)[)\]]\s*[.:]?\s*(.*)$"
    sketch = r"^(?i:(?:sketch|outline)\s+of\s+(?:the\s+)?proof)\s*[.:]?\s*(.*)$"
    of = r"^(?i:proof\s+of)\s+([^.:]*)[.:]\s*(.*)$"
    plain = r"^(?i:proof)\s*(?:[.:]\s*(.*)|$)"
    kind = F.when(line.rlike(bracket), "bracket").when(line.rlike(sketch), "sketch").when(line.rlike(of), "of").when(line.rlike(plain), "plain")
    arg = F.when(kind == "bracket", F.regexp_extract(line, bracket, 1)).when(kind == "of", F.regexp_extract(line, of, 1)).otherwise("")
    rest = F.when(kind == "bracket", F.regexp_extract(line, bracket, 2)).when(kind == "sketch", F.regexp_extract(line, sketch, 1)).when(kind == "of", F.regexp_extract(line, of, 2)).otherwise(F.regexp_extract(line, plain, 1))
    return F.struct(kind.alias("kind"), F.trim(arg).alias("argument"), F.when(kind.isNotNull(), F.trim(rest)).alias("remainder"))


def ocr_document(text: Column) -> Column:
    """Whether a text has at least two page markers, as merged pages do."""
    return F.regexp_count(text, F.lit(r"(?m)^%% page \d+")) >= 2
