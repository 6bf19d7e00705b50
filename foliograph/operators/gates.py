"""Verification gates: what an edit must leave as it was. Masked text is compared, so comments and literal bodies don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python_text import formula_bodies, masked_tex, visible_text
from ..functions.text import collapse_space
from . import tex
from .storage import below, written
from .structure import brace_balance

#: What is counted, and the pattern that finds it; fixed by TeX's commands.
INVENTORY = {
    "labels": r"\\label\s*\{([^{}]*)\}",
    "refs": r"\\(?:ref|eqref|pageref|autoref|cref|Cref)\s*\{([^{}]*)\}",
    "cites": r"\\(?:cite|citep|citet|citealp|citealt|parencite|footcite)(?:\s*\[[^\]]*\]){0,2}\s*\{([^{}]*)\}",
    "images": r"\\includegraphics\*?(?:\s*\[[^\]]*\])?\s*\{([^{}]*)\}",
}
#: Displays, brackets, parentheses and dollars; formula environments give their bodies beside.
MATH = [r"(?s)\$\$(.*?)\$\$", r"(?s)\\\[(.*?)\\\]", r"(?s)\\\((.*?)\\\)", r"(?<!\\)\$([^$\n]+)\$"]


def found(text: Column, pattern: str) -> Column:
    """What a pattern's first group finds."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def math_tokens(masked: Column, bodies: Column) -> Column:
    """The sorted multiset of formulas in masked text and of the ``bodies`` of its formula environments, white space collapsed. A formula
    inside another counts for both."""
    return F.sort_array(F.concat(*[F.transform(found(masked, p), collapse_space) for p in MATH], bodies))


def missing(before: Column, after: Column) -> Column:
    """Members of one sorted multiset that the other has less often, with repeats."""
    n = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.flatten(F.transform(F.array_distinct(before), lambda x: F.when(n(before, x) > n(after, x), F.array_repeat(x, n(before, x) - n(after, x))).otherwise(F.array().cast("array<string>"))))


def check_edits(pairs: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """key, check, ok, missing and extra (a report of at most ``most`` each) of ``before`` and ``after``: every inventory and formulas
    must be equal; braces and environments must balance behind the edit, or be as they were before it."""
    masks = pairs.select(key, masked_tex("before").alias("b"), masked_tex("after").alias("a"))
    masks = written(masks.select("*", formula_bodies("b").alias("b_bodies"), formula_bodies("a").alias("a_bodies")), "masks")
    sides = [F.col("b"), F.col("a")]
    checks = [(name, *[F.sort_array(found(t, pattern)) for t in sides]) for name, pattern in INVENTORY.items()]
    checks.append(("math", math_tokens(F.col("b"), F.col("b_bodies")), math_tokens(F.col("a"), F.col("a_bodies"))))
    one = lambda name, b, a: F.struct(F.lit(name).alias("check"), b.eqNullSafe(a).alias("ok"), F.slice(missing(b, a), 1, most).alias("missing"), F.slice(missing(a, b), 1, most).alias("extra"))
    none = F.array().cast("array<string>")
    before, after = map(brace_balance, sides)
    braces = F.struct(F.lit("braces").alias("check"), (after["ok"] | before.eqNullSafe(after)).alias("ok"), none.alias("missing"), none.alias("extra"))
    rows = masks.select(key, F.inline(F.array(*[one(*c) for c in checks], braces)))
    environments = compare_environments(pairs, key)
    return below(rows, environments.select(key, F.lit("environments").alias("check"), "ok", F.slice("before", 1, most).alias("missing"), F.slice("after", 1, most).alias("extra")), keys=[key])


def compare_environments(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ok, before and after: the sorted names of openers left and closers refused. An edit may not bring new ones."""

    def unbalanced(side: str) -> DataFrame:
        rows = tex.rows(pairs.select(key, F.col(side).alias("text")), "unbalanced", key)
        named = F.concat(F.when(F.col("side") == "open", "begin ").otherwise("end "), F.col("name"))
        return rows.groupBy(key).agg(F.sort_array(F.collect_list(named)).alias(side))

    none = F.array().cast("array<string>")
    both = pairs.select(key).join(unbalanced("before"), key, "left").join(unbalanced("after"), key, "left")
    both = both.select(key, F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
    return both.select(key, ((F.size("after") == 0) | (F.col("before") == F.col("after"))).alias("ok"), "before", "after")


#: Checks that decide over an edited text. One that isn't there for a text counts as skipped.
FINAL = ["content", "environments", "braces", "math", "labels", "refs", "cites", "images", "display-math", "outline", "resources", "compile"]


def final_gate(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, accepted, failed (names, in FINAL's order) and skipped of rows (key, check, ok): accepted if no check says no, and at least one says yes."""
    names = F.array(*[F.lit(n) for n in FINAL])
    by = checks.filter(F.col("check").isin(FINAL)).groupBy(key).agg(F.collect_set(F.when(F.col("ok"), F.col("check"))).alias("yes"), F.collect_set(F.when(~F.col("ok"), F.col("check"))).alias("no"))
    failed = F.filter(names, lambda n: F.array_contains("no", n))
    skipped = F.filter(names, lambda n: ~F.array_contains("no", n) & ~F.array_contains("yes", n))
    return by.select(key, ((F.size("no") == 0) & (F.size("yes") > 0)).alias("accepted"), failed.alias("failed"), skipped.alias("skipped"))


#: Text environments that a display may not reach out of.
OUTER = ["theorem", "lemma", "proposition", "corollary", "definition", "remark", "example", "exercise"]
OUTER = [*OUTER, *[f"{n}*" for n in OUTER], "proof"]


def display_issues(masked: DataFrame, key: str, text: str = "masked", outer: list[str] | None = None) -> DataFrame:
    r"""key, pos and issue of what is wrong with ``\[`` and ``\]``: opened twice, closed without an opener, a ``\tag`` or the end of an
    outer environment inside, and left open. Whatever a delimiter meets, what follows is inside after an opener and outside after a closer."""
    outer = OUTER if outer is None else outer
    token = r"(?<!\\)\\[\[\]]|(?<!\\)\\tag(?![A-Za-z@])|\\(?:begin|end)\s*\{[^{}\s]+\}"
    rows = masked.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"({token})"), F.lit(1))).alias("pos", "t"))
    name = F.regexp_extract("t", r"\{([^{}]+)\}", 1)
    kind = F.when(F.col("t") == "\\[", "open").when(F.col("t") == "\\]", "close").when(F.col("t") == "\\tag", "tag").when(F.col("t").startswith("\\begin"), "begin").otherwise("end")
    rows = rows.select(key, "pos", kind.alias("kind"), name.alias("name"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(F.when(F.col("kind").isin("open", "close"), F.col("kind") == "open"), ignorenulls=True).over(w), F.lit(False))
    rows = rows.withColumn("inside", inside)
    tokens = rows.filter(F.col("kind").isin("begin", "end") & F.col("name").isin(outer)).select(key, "pos", "name", F.when(F.col("kind") == "begin", "open").otherwise("close").alias("kind"))
    ends = tex.closers(tokens, key).select(key, "pos", F.lit(True).alias("_paired"))
    rows = rows.join(ends, [key, "pos"], "left")
    issue = (
        F.when((F.col("kind") == "open") & F.col("inside"), "opened twice")
        .when((F.col("kind") == "close") & ~F.col("inside"), "closed without an opener")
        .when((F.col("kind") == "tag") & F.col("inside"), "tag inside")
        .when(F.col("_paired") & F.col("inside"), "environment ends inside")
    )
    last = rows.filter(F.col("kind").isin("open", "close")).groupBy(key).agg(F.max_by("kind", "pos").alias("kind"), F.max("pos").alias("pos")).filter("kind = 'open'")
    return rows.withColumn("issue", issue).filter("issue IS NOT NULL").select(key, "pos", "issue").transform(below, last.select(key, "pos", F.lit("left open").alias("issue")), keys=[key])


#: Known trouble in sources that is reported and not mended: a name and its pattern.
KNOWN_ISSUES = {"matrix behind a stretched bracket": r"\\left\s*\(\s*\\begin\{matrix\}"}


def known_issues(masked_lines: DataFrame, key: str, line: str = "line", text: str = "masked", patterns: dict[str, str] | None = None) -> DataFrame:
    """key, line and issue of every known pattern in masked lines."""
    hits = [F.when(F.col(text).rlike(p), n) for n, p in (KNOWN_ISSUES if patterns is None else patterns).items()]
    return masked_lines.select(key, line, F.explode(F.array_compact(F.array(*hits))).alias("issue"))


def accept_or_restore(pairs: DataFrame, checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text and accepted: the edited text if every check holds, else the source."""
    good = checks.groupBy(key).agg(F.bool_and("ok").alias("accepted"))
    out = pairs.join(good, key, "left")
    return out.select(key, F.when(F.col("accepted"), F.col("after")).otherwise(F.col("before")).alias("text"), F.coalesce("accepted", F.lit(False)).alias("accepted"))


def failures(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Failed checks, local paths taken out of what they tell."""
    told = F.array_join(F.concat(F.col("missing"), F.col("extra")), "; ")
    return checks.filter(~F.col("ok")).select(key, "check", F.regexp_replace(told, r"(?:/home/|/Users/|[A-Z]:\\Users\\)\S+", "[path]").alias("told"))


def missing_images(references: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """References (key, path) of which no file exists. Suffixes are tried where the reference has none: ``a.png`` doesn't mean ``a.png.png``."""
    bare = ~F.substring_index("path", "/", -1).contains(".")
    names = F.when(bare, F.array(F.col("path"), *[F.concat("path", F.lit(s)) for s in suffixes])).otherwise(F.array("path"))
    tries = references.withColumn("_try", F.explode(names))
    there = tries.join(files.select(F.col("path").alias("_try")), "_try", "left_semi").select(references.columns).distinct()
    return references.join(there, references.columns, "left_anti")


def stamp(text: Column, record: dict[str, str]) -> Column:
    """The text under a comment block that tells where it comes from; an earlier block is replaced."""
    lines = "".join(f"% provenance {k}: {v}\n" for k, v in sorted(record.items()))
    return F.concat(F.lit(lines), strip_stamp(text))


def strip_stamp(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?:% provenance [^\n]*\n)+", "")


def read_stamp(text: Column) -> Column:
    rows = F.regexp_extract_all(F.regexp_extract(text, r"^((?:% provenance [^\n]*\n)*)", 1), F.lit(r"(?m)^% provenance ([^:\n]+: [^\n]*)$"), F.lit(1))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(F.regexp_extract(r, "^([^:]+): ", 1), F.regexp_extract(r, "^[^:]+: (.*)$", 1))))


def style_revision(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ``ok``: whether an edit changed nothing but style, for what a reader sees is what it was and every check of ``check_edits`` holds."""
    seen = written(pairs.select(key, visible_text(masked_tex("before")).alias("b"), visible_text(masked_tex("after")).alias("a")), "visible")
    good = check_edits(pairs, key).groupBy(key).agg(F.bool_and("ok").alias("_ok"))
    return seen.join(good, key).select(key, ((F.col("a") == F.col("b")) & F.col("_ok")).alias("ok"))


def structure_check(documents: DataFrame, key: str = "doc_id", literal: list[str] | None = None) -> DataFrame:
    """key, check and n: what is wrong with a source's structure: unbalanced environments, sections that jump a level, headings that repeat."""
    loose = tex.rows(documents, "unbalanced", key, literal=literal).groupBy(key).agg(F.count("*").alias("n")).withColumn("check", F.lit("environments"))
    sections = written(tex.rows(documents, "sections", key, literal=literal), "sections")
    before = F.lag("level").over(Window.partitionBy(key).orderBy("n"))
    jumps = sections.withColumn("_b", before).filter(F.col("level") > F.col("_b") + 1).groupBy(key).agg(F.count("*").alias("n")).withColumn("check", F.lit("levels"))
    again = sections.groupBy(key, "cmd", "title").agg(F.count("*").alias("c")).filter("c > 1").groupBy(key).agg(F.sum(F.col("c") - 1).alias("n")).withColumn("check", F.lit("repeats"))
    return below(loose, jumps, again, keys=[key]).select(key, "check", "n")
