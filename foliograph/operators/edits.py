"""Edit plans over lines: operations from decisions, validation, application with renumbering, and reversal.

An operation is (key, decision, seq, kind, line, old, new) with kind ``delete``, ``replace``, ``prefix`` (the beginning ``old`` becomes
``new``) or ``insert`` (behind ``line``; 0 is the top). At one line deletes come first, then changes, then inserts, each in plan order
(``seq``). A line that is deleted has no other change, and is deleted once, however many operations say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import below

#: Columns that a decision may have beside key, decision, seq and action; those that are missing are null.
DECISION = {
    "env": "string", "start": "int", "end": "int", "optional_arg": "string", "prefix": "string", "line_old": "string", "line_new": "string",
    "quiet_qed": "boolean", "old_end": "int", "new_end": "int", "item_lines": "array<int>", "section_line": "int", "cmd": "string",
    "title": "string", "translated": "string", "box_start": "int", "box_end": "int", "anchor": "int", "declared": "array<string>",
    "required": "array<string>", "theorem_package": "string",
}
#: What is put before a proof's end where its own end sign stays.
QUIET_QED = r"\ifcsname qedsymbol\endcsname\let\qedsymbol\empty\fi"
#: Styles of theorem environments in the order of their declaration, and the names that each declares.
THEOREM_STYLES = {
    "plain": ["theorem", "lemma", "proposition", "corollary", "conjecture", "claim", "fact"],
    "remark": ["remark", "observation", "note"],
    "definition": ["definition", "example", "problem", "question", "exercise"],
}
#: Operations of a decision at most; a plan's order is (decision, place in the decision).
PLACES = 1_000_000


def rank(kind: Column) -> Column:
    """Deletes come before changes, and these before inserts, at one line."""
    return F.when(kind == "delete", 0).when(kind == "insert", 2).otherwise(1)


def _op(kind: str, line: Column, new: Column | None = None, old: Column | None = None, expect: Column | None = None) -> Column:
    """``expect`` is a pattern that the line must match whole. Without ``old``, a prefix is the line's bare number, else it is the line."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), text(old).alias("old"), text(new).alias("new"), text(expect).alias("expect"))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^A-Za-z0-9])", r"\\$1")


def _preamble() -> Column:
    """Lines that a preamble lacks: the package, styles and environments that are required and not declared."""
    c = F.col
    wanted = lambda n: ~F.array_contains(F.coalesce(c("declared"), F.array().cast("array<string>")), n) & (c("required").isNull() | F.array_contains(c("required"), n))
    package = F.coalesce(c("theorem_package"), F.lit(""))
    out = [F.when(package == "", F.lit(r"\usepackage{amsthm}"))]
    for style, names in THEOREM_STYLES.items():
        out.append(F.when(package != "ntheorem", F.lit(rf"\theoremstyle{{{style}}}")))
        out += [F.when(wanted(F.lit(n)), F.lit(rf"\newtheorem*{{{n}}}{{{n.capitalize()}}}")) for n in names]
    return F.array_compact(F.array(*out))


def plan(decisions: DataFrame, key: str) -> DataFrame:
    """Operations (key, decision, seq, kind, line, old, new, expect) and decisions that can't be planned, with ``error``, in one table.

    Actions: ``wrap`` (an environment around start..end, its title taken off), ``move-boundary``, ``convert-to-exercise-env``,
    ``merge-bilingual-title``, ``preamble-add``, ``none``.
    """
    c = F.col
    for name, kind in DECISION.items():
        if name not in decisions.columns:
            decisions = decisions.withColumn(name, F.lit(None).cast(kind))
    begin = F.concat(F.lit(r"\begin{"), "env", F.lit("}"), F.when(F.coalesce(c("optional_arg"), F.lit("")) != "", F.concat(F.lit("["), "optional_arg", F.lit("]"))).otherwise(""))
    end = F.concat(F.lit(r"\end{"), "env", F.lit("}"))
    quiet = F.when((c("env") == "proof") & c("quiet_qed"), _op("insert", c("end"), F.lit(QUIET_QED)))
    styled = (F.coalesce(c("line_old"), F.lit("")) != "") & (F.coalesce(c("line_new"), F.lit("")) != "")
    title = F.when(styled, _op("replace", c("start"), c("line_new"), c("line_old"))).when(F.coalesce(c("prefix"), F.lit("")) != "", _op("prefix", c("start"), F.lit(""), c("prefix")))
    wrap = F.array(_op("insert", c("start") - 1, begin), quiet, _op("insert", c("end"), end), title)
    closer = F.concat(F.lit(r"\s*"), _quoted(end), F.lit(r"\s*"))
    move = F.array(_op("delete", c("old_end"), expect=closer), _op("insert", c("new_end"), end))
    items = F.array_sort(c("item_lines"))
    item_env = F.coalesce(F.nullif(c("env"), F.lit("")), F.lit("enumerate"))
    numbered = F.transform(items, lambda i: _op("prefix", i, F.lit(r"\item ")))
    fence = lambda which, at: F.array(_op("insert", at, F.concat(F.lit(rf"\{which}{{"), item_env, F.lit("}"))))
    exercise = F.concat(fence("begin", F.get(items, 0) - 1), numbered, fence("end", F.element_at(items, -1)))
    both = F.concat("title", F.lit("（"), "translated", F.lit("）"))
    heading = F.concat(F.lit("\\"), "cmd", F.lit("*{"), both, F.lit("}"))
    old_heading = F.concat(F.lit("\\"), "cmd", F.lit("*{"), "title", F.lit("}"))
    contents = F.concat(F.lit(r"\addcontentsline{toc}{"), "cmd", F.lit("}{"), both, F.lit("}"))
    box = F.when(c("box_start") <= c("box_end"), F.sequence("box_start", "box_end"))
    gone = F.transform(box, lambda i: _op("delete", i))
    bilingual = F.concat(F.array(_op("replace", c("section_line"), heading, expect=F.concat(F.lit(r"\s*"), _quoted(old_heading), F.lit(r"\s*"))), _op("insert", c("section_line"), contents)), gone)
    preamble = F.transform(_preamble(), lambda t: _op("insert", c("anchor") - 1, t))

    action = c("action")
    fine = lambda cond, text: F.when(~F.coalesce(cond, F.lit(False)), F.lit(text))
    error = (
        F.when(action == "wrap", fine((c("start") >= 1) & (c("start") <= c("end")), "no range to wrap"))
        .when(action == "move-boundary", fine(c("old_end") >= 1, "no boundary to move"))
        .when(action == "convert-to-exercise-env", fine(F.size(items) >= 2, "fewer than two items"))
        .when(action == "merge-bilingual-title", fine((c("section_line") >= 1) & (c("box_start") >= 1) & (c("box_start") <= c("box_end")), "no title or box to merge"))
        .when(action == "preamble-add", fine(c("anchor") > 0, "no preamble"))
        .when(action != "none", F.lit("unknown action"))
    )
    none = F.array().cast("array<struct<kind:string,line:int,old:string,new:string,expect:string>>")
    ops = (
        F.when(error.isNotNull(), none).when(action == "wrap", F.array_compact(wrap)).when(action == "move-boundary", move).when(action == "convert-to-exercise-env", exercise)
        .when(action == "merge-bilingual-title", bilingual).when(action == "preamble-add", preamble).otherwise(none)
    )
    rows = decisions.select(key, "decision", "seq", error.alias("error"), F.posexplode_outer(ops).alias("_place", "_op"))
    return rows.filter("_op IS NOT NULL OR error IS NOT NULL").select(key, "decision", (c("seq") * PLACES + F.coalesce("_place", F.lit(0))).cast("long").alias("seq"), "_op.*", "error")


def wrap_ops(decisions: DataFrame, key: str) -> DataFrame:
    """Operations of decisions (key, decision, seq, env, start, end) that wrap a range."""
    return plan(decisions.withColumn("action", F.lit("wrap")), key).filter("error IS NULL").drop("expect", "error")


def validated(ops: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Operations with ``old`` filled in and ``error``, null for what fits. Deletes and replacements need their line and, if given,
    its text; prefixes a line that begins so; inserts a place from 0 to the last line, 0 where no line is left."""
    with_expect = ops if "expect" in ops.columns else ops.withColumn("expect", F.lit(None).cast("string"))
    with_error = with_expect if "error" in ops.columns else with_expect.withColumn("error", F.lit(None).cast("string"))
    at = lines.select(key, "line", F.col("text").alias("_text"))
    last = lines.groupBy(key).agg(F.max("line").alias("_last"))
    rows = with_error.join(at, [key, "line"], "left").join(last, key, "left")
    matches = F.col("expect").isNull() | F.rlike(F.col("_text"), F.concat(F.lit("^(?:"), "expect", F.lit(")$")))
    own = F.when(F.col("kind") == "prefix", F.regexp_extract("_text", r"^(\s*\d+\.\s*)", 1)).otherwise(F.col("_text"))
    old = F.when(F.col("kind") != "insert", F.coalesce("old", own))
    whole = F.col("_text").isNotNull() & matches & (F.col("_text") == old)
    begins = F.col("_text").isNotNull() & matches & (old != "") & F.startswith(F.col("_text"), old)
    fits = F.when(F.col("kind") == "insert", F.col("line").between(0, F.coalesce("_last", F.lit(0)))).when(F.col("kind") == "prefix", begins).otherwise(whole)
    error = F.coalesce(F.col("error"), F.when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" isn't as expected"))))
    return rows.select(key, "decision", "seq", "kind", "line", old.alias("old"), "new", error.alias("error"))


def valid_ops(ops: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Operations of decisions of which every operation fits: one misfit drops the decision."""
    good = F.bool_and(F.col("error").isNull()).over(Window.partitionBy(key, "decision"))
    return validated(ops, lines, key).withColumn("_ok", good).filter("_ok").drop("_ok", "error")


def rejected(ops: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """key, decision and the first error of each decision that is dropped."""
    return validated(ops, lines, key).filter("error IS NOT NULL").groupBy(key, "decision").agg(F.min_by("error", "seq").alias("error"))


def _merged(lines: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """Lines and inserts in their new order, deleted lines among them: key, _at, _sub, _seq, text (before), _new (behind changes), _gone.

    Lines, changes and inserts are put side by side and meet in one shuffle by key: no join by line.
    """
    null = lambda kind: F.lit(None).cast(kind)
    change = "array<struct<seq:bigint,kind:string,old:string,new:string>>"
    own = lines.select(key, F.col("line").alias("_at"), F.lit(1).alias("_sub"), F.lit(0).cast("long").alias("_seq"), "text", null(change).alias("_changes"))
    touched = ops.filter("kind <> 'insert'").groupBy(key, "line").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "kind", "old", "new"))).alias("_changes"))
    touched = touched.select(key, F.col("line").alias("_at"), F.lit(0).alias("_sub"), F.lit(0).cast("long").alias("_seq"), null("string").alias("text"), "_changes")
    added = ops.filter("kind = 'insert'").select(key, F.col("line").alias("_at"), F.lit(2).alias("_sub"), F.col("seq").cast("long").alias("_seq"), F.col("new").alias("text"), null(change).alias("_changes"))
    rows = below(own, touched, added, keys=[key]).repartition(key)
    w = Window.partitionBy(key, "_at").orderBy("_sub", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_changes", F.when(F.col("_sub") == 1, F.last("_changes", ignorenulls=True).over(w))).filter("_sub > 0")

    def step(text: Column, o: Column) -> Column:
        return F.when(o["kind"] == "replace", o["new"]).when(o["kind"] == "prefix", F.concat(o["new"], F.substring(text, F.length(o["old"]) + 1, F.length(text)))).otherwise(text)

    gone = F.coalesce(F.exists("_changes", lambda o: o["kind"] == "delete"), F.lit(False))
    new = F.coalesce(F.aggregate("_changes", F.col("text"), step), F.col("text"))
    return rows.select(key, "_at", "_sub", "_seq", "text", new.alias("_new"), gone.alias("_gone"))


def apply_ops(lines: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """key, line and text after the edits; lines are numbered anew. Texts without an operation pass as they are, without a shuffle."""
    touched = ops.select(key).distinct()
    n = F.row_number().over(Window.partitionBy(key).orderBy("_at", "_sub", "_seq"))
    edited = _merged(lines.join(touched, key, "left_semi"), ops, key).filter("NOT _gone").select(key, n.alias("line"), F.col("_new").alias("text"))
    return below(lines.join(touched, key, "left_anti").select(key, "line", "text"), edited, keys=[key])


def inverse_ops(lines: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """Operations on the edited lines that give ``lines`` back. ``old`` says what must be there: a result that was changed since isn't undone."""
    w = Window.partitionBy(key).orderBy("_at", "_sub", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = _merged(lines.join(ops.select(key).distinct(), key, "left_semi"), ops, key).withColumn("_line", F.sum((~F.col("_gone")).cast("int")).over(w).cast("int"))
    kind = F.when(F.col("_sub") == 2, "delete").when(F.col("_gone"), "insert").when(~F.col("text").eqNullSafe(F.col("_new")), "replace")
    seq = F.row_number().over(Window.partitionBy(key).orderBy("_at", "_sub", "_seq")).cast("long")
    return placed.withColumn("kind", kind).withColumn("seq", seq).filter("kind IS NOT NULL").select(
        key, F.concat(F.lit("undo-"), F.col("seq").cast("string")).alias("decision"), "seq", "kind", F.col("_line").alias("line"), F.when(F.col("kind") != "insert", F.col("_new")).alias("old"), F.when(F.col("kind") != "delete", F.col("text")).alias("new")
    )


def single_edit_lines(ops: DataFrame, key: str) -> DataFrame:
    """Operations on lines that no different operation touches; colliding ones all go."""
    n = F.count("*").over(Window.partitionBy(key, "line"))
    return ops.distinct().withColumn("_n", n).filter("_n = 1").drop("_n")


def digest(lines: DataFrame, key: str) -> DataFrame:
    """key and the SHA-256 of its lines in order."""
    rows = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    return rows.select(key, F.sha2(F.array_join(F.transform("l", lambda x: x.text), "\n"), 256).alias("sha256"))


def unchanged(lines: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """key and whether applying the operations and undoing them gives the lines again."""
    edited = apply_ops(lines, ops, key)
    back = apply_ops(edited, valid_ops(inverse_ops(lines, ops, key), edited, key), key)
    before, after = digest(lines, key), digest(back, key).withColumnRenamed("sha256", "_after")
    return before.join(after, key, "full_outer").select(key, F.col("sha256").eqNullSafe(F.col("_after")).alias("ok"))


def all_or_nothing(ops: DataFrame, ok: Column, key: str) -> DataFrame:
    """A key's operations if the condition holds for all of them."""
    return ops.withColumn("_all", F.bool_and(ok).over(Window.partitionBy(key))).filter("_all").drop("_all")
