"""Inventories of sources: numbered equations, bibliographies, front matter, headings that repeat, headers, line ends, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import break_verdict, collapse_space

#: A literal equation number at the beginning or the end of a display; fixed by convention.
NUMBER = r"\((\d+(?:\.\d+)*[a-z]?)\)"
HEADING = r"^\s*(?:\\(?:chapter|section)\*?\{)?\s*(?i:references|bibliography|literature)\s*\}?\s*$"
ITEM = r"^\s*\[?([1-9][0-9]*)[\].]\s*\S"
#: Commands and environments of front matter; fixed values.
FRONT = ["title", "author", "date", "dedication", "keywords"]
FRONT_ENVS = ["abstract", "dedication", "preface"]


def equations(displays: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Displays with ``label``, ``representation`` (tag, prefix, suffix, none), the digest of the body without its number, and ``rewritable``:
    a number stands alone at one end, and there is no active tag beside it."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"^\s*(?:\\\[|\$\$)", ""), r"(?:\\\]|\$\$)\s*$", "")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    tag = F.regexp_extract(body, r"\\tag\s*\{([^{}]*)\}", 1)
    prefix = F.regexp_extract(body, rf"^{NUMBER}(?s:\s.*)$", 1)
    suffix = F.regexp_extract(body, rf"^(?s:.*\s){NUMBER}$", 1)
    active = body.rlike(r"(?<!\\)\\tag(?![A-Za-z@])")
    kind = F.when(active, "tag").when((prefix != "") & (suffix == ""), "prefix").when((suffix != "") & (prefix == ""), "suffix").otherwise("none")
    label = F.when(kind == "tag", tag).when(kind == "prefix", prefix).when(kind == "suffix", suffix).otherwise("")
    bare = F.when(kind == "prefix", F.regexp_replace(body, rf"^{NUMBER}\s", "")).when(kind == "suffix", F.regexp_replace(body, rf"\s{NUMBER}$", "")).otherwise(body)
    return displays.withColumns({"representation": kind, "label": label, "payload_sha256": F.sha2(collapse_space(bare), 256), "rewritable": kind.isin("prefix", "suffix")})


def bibliography(lines: DataFrame, key: str, line: str = "line", text: str = "text") -> DataFrame:
    """key, number, start_line, end_line and ``ok`` of the numbered entries behind a document's heading of references. ``ok`` holds for all of a
    document's entries or none: there is one heading, and the numbers are 1..N in order. An entry ends in front of the next one, and the last
    with the last line that isn't blank."""
    w = Window.partitionBy(key).orderBy(line)
    heading = F.col(text).rlike(HEADING)
    rows = lines.withColumn("_heads", F.sum(heading.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter((F.col("_heads") > 0) & ~heading & (F.trim(text) != ""))
    number = F.regexp_extract(text, ITEM, 1).try_cast("int")
    rows = rows.withColumns({"_n": number, "_entry": F.sum(number.isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    entries = rows.filter("_entry > 0").groupBy(key, "_entry").agg(F.max("_n").alias("number"), F.min(line).alias("start_line"), F.max(line).alias("end_line"), F.max("_heads").alias("_heads"))
    good = F.bool_and((F.col("_heads") == 1) & (F.col("number") == F.col("_entry"))).over(Window.partitionBy(key))
    return entries.select(key, "number", "start_line", "end_line", good.alias("ok"))


def front_matter(masked: DataFrame, key: str, text: str = "masked") -> DataFrame:
    """key, kind, source (command or environment) and payload_sha256 of front matter in masked text, in order."""
    names = "|".join(FRONT)
    commands = F.regexp_extract_all(text, F.lit(rf"(\\(?:{names})\s*\{{[^{{}}]*\}})"), F.lit(1))
    envs = "|".join(FRONT_ENVS)
    bodies = F.regexp_extract_all(text, F.lit(rf"(?s)(\\begin\{{(?:{envs})\}}.*?\\end\{{(?:{envs})\}})"), F.lit(1))
    row = lambda source, pattern, body: lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("kind"), F.lit(source).alias("source"), F.sha2(collapse_space(F.regexp_extract(x, body, 1)), 256).alias("payload_sha256"))
    found = F.concat(F.transform(commands, row("command", r"^\\([a-z]+)", r"(?s)\{(.*)\}$")), F.transform(bodies, row("environment", r"^\\begin\{([a-z]+)\}", r"(?s)^\\begin\{[a-z]+\}(.*)\\end\{[a-z]+\}$")))
    return masked.select(key, F.posexplode(found).alias("n", "f")).select(key, "n", "f.*")


def repeated(found: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Headings that stand more often than expected, and more than once: by, n and expected."""
    have = found.groupBy(*by).agg(F.count("*").alias("n"))
    want = expected.groupBy(*by).agg(F.count("*").alias("expected"))
    rows = have.join(want, by, "left").na.fill(0, ["expected"])
    return rows.filter(F.col("n") > F.greatest(F.lit(1), F.col("expected")))


def running_headers(lines: DataFrame, page: list[str], line: str, text: str, top: int) -> DataFrame:
    """Texts among the first ``top`` lines of at least two pages: text, n and n_pages."""
    near = lines.filter((F.col(line) <= top) & (F.trim(text) != ""))
    per = near.groupBy(F.trim(text).alias(text), *page).agg(F.count("*").alias("_n"))  # a page counts once, however hot a text is
    return per.groupBy(text).agg(F.sum("_n").alias("n"), F.count("*").alias("n_pages")).filter("n_pages >= 2 AND n >= 2")


def line_ends(lines: DataFrame, lexicon: DataFrame, key: str, line: str = "line", text: str = "text", least: int = 2) -> DataFrame:
    """Lines that end in a hyphen with the fragments on both sides, how often the corpus has the joined and the hyphenated form, and the verdict."""
    left = F.regexp_extract(F.lower(text), r"([\p{L}]+)-\s*$", 1)
    right = F.regexp_extract(F.lower(F.lead(text).over(Window.partitionBy(key).orderBy(line))), r"^\s*([\p{L}]+)", 1)
    rows = lines.select(key, line, left.alias("left_part"), right.alias("right_part")).filter("left_part <> '' AND right_part <> ''")
    named = lambda n: lexicon.select(F.col("word").alias(f"_{n}"), F.col("n").alias(n))
    rows = rows.withColumns({"_joined": F.concat("left_part", "right_part"), "_hyphenated": F.concat_ws("-", "left_part", "right_part")})
    out = rows.join(named("joined"), "_joined", "left").join(named("hyphenated"), "_hyphenated", "left").na.fill(0, ["joined", "hyphenated"])
    return out.withColumn("verdict", break_verdict(F.col("joined"), F.col("hyphenated"), least)).drop("_joined", "_hyphenated")


def nearest_midpoint(spans: DataFrame, key: str, ident: str, start: str = "s", end: str = "e") -> DataFrame:
    """Each span with the span of its key whose midpoint is nearest (the earlier one, then the least id, among equals) and twice the distance; two
    windows, no join."""
    middle = F.col(start) + F.col(end)
    w = Window.partitionBy(key).orderBy("_m", ident)
    rows = spans.withColumn("_m", middle)
    before, after = F.lag(F.struct("_m", ident)).over(w), F.lead(F.struct("_m", ident)).over(w)
    rows = rows.withColumns({"_b": before, "_a": after})
    nearer = (F.col("_a").isNull()) | (F.col("_m") - F.col("_b._m") <= F.col("_a._m") - F.col("_m"))
    pick = F.when(F.col("_b").isNotNull() & nearer, F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumns({"nearest": pick[ident], "distance": F.abs(pick["_m"] - F.col("_m"))}).drop("_m", "_b", "_a")


def lineage(artifacts: DataFrame, ident: Column, steps: list[str]) -> DataFrame:
    """child and parent of a chain for each artifact: every step's record names the one before it."""
    names = [F.concat_ws("/", ident, F.lit(s)) for s in steps]
    links = [F.struct(F.lit(s).alias("step"), F.sha2(n, 256).alias("child"), (F.sha2(names[k - 1], 256) if k else F.lit(None).cast("string")).alias("parent")) for k, (s, n) in enumerate(zip(steps, names))]
    return artifacts.select(ident.alias("artifact"), F.inline(F.array(*links)))


def resolved(rows: DataFrame, options: list[str], levels: list[str]) -> DataFrame:
    """Each option's value from the strongest level that gives one; levels are struct columns, the strongest first."""
    return rows.withColumns({o: F.coalesce(*[F.col(f"{level}.{o}") for level in levels]) for o in options})


#: Relations between two names or numbers; fixed by notation.
RELATION = r"([A-Za-z][A-Za-z0-9]*)\s*(<=|>=|!=|<|>|=|\\leq|\\geq|\\neq)\s*([A-Za-z0-9]+)"


def relation_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, left, right (lower case), the sorted operators that a text claims between them, and how often."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"(?:{RELATION})"), F.lit(0))).alias("t"))
    part = lambda n: F.regexp_extract("t", RELATION, n)
    sign = part(2)
    same = F.when(sign == r"\leq", "<=").when(sign == r"\geq", ">=").when(sign == r"\neq", "!=").otherwise(sign)
    rows = found.select(key, F.lower(part(1)).alias("left"), same.alias("operator"), F.lower(part(3)).alias("right"))
    return rows.groupBy(key, "left", "right").agg(F.array_join(F.sort_array(F.collect_set("operator")), ",").alias("operators"), F.count("*").alias("n"))
