"""String functions as Columns: normalising, masking, tokens, keys, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes for characters that TeX reserves; fixed values.
TEX_ESCAPES = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "%": r"\%", "&": r"\&", "#": r"\#", "$": r"\$", "_": r"\_", "^": r"\textasciicircum{}", "~": r"\textasciitilde{}"}


def normalise_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)  # most texts have none


def newline_of(text: Column) -> Column:
    """The newline of a text: CRLF if it has one, else CR if it has one, else LF."""
    return F.when(text.contains("\r\n"), "CRLF").when(text.contains("\r"), "CR").otherwise("LF")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def mask_comment(line: Column, marker: str = "%") -> Column:
    """The line with its comment blanked, of the same length. A marker behind an odd number of backslashes is text."""
    visible = F.regexp_extract(line, rf"^([^\\{marker}]*+(?:\\.[^\\{marker}]*+)*+(?:\\$)?)", 1)  # possessive: long lines need no stack
    return F.when(line.contains(marker), F.rpad(visible, F.length(line), " ")).otherwise(line)  # most lines have none


def tokens(text: Column) -> Column:
    """Words and single marks, in Unicode's sense of a word character."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), F.lit(1))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas inside ``body`` refer to it."""
    return F.transform(F.array(value), body)[0]


#: Numbers that are summed in one fold; the sums of these groups are summed in another one.
GROUP = 256


def sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those in front of it. Folds copy what they have built at every step, so they run over groups
    and then over the groups' sums: the cost grows with the array, not with its square."""
    empty = F.array().cast("array<bigint>")

    def ends(own: Column, base: Column) -> Column:
        start = F.struct(base.cast("bigint").alias("at"), empty.alias("out"))
        return F.aggregate(own, start, lambda a, x: F.struct((a.at + x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")), lambda a: a.out)

    def of(own: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(GROUP))
        groups = F.transform(firsts, lambda i: F.slice(own, i, GROUP))
        totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return let(ends(totals, F.lit(0)), lambda b: F.flatten(F.transform(groups, lambda g, k: ends(g, F.get(b, k)))))

    return let(sizes, of)


def letters_key(text: Column) -> Column:
    """Lower-case letters, digits and symbols, nothing else: a key for comparing titles in composed text."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{S}]", "")


def escape_tex(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TEX_ESCAPES.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def host(url: Column) -> Column:
    """The lower-case host of a URL without a trailing dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", ""), F.lit(""))


def safe_path(path: Column) -> Column:
    """True for relative paths without empty, ``.`` or ``..`` parts, drive letters or NUL."""
    bad = F.exists(F.split(path, r"[/\\]"), lambda x: x.isin("", ".", ".."))
    return ~bad & ~path.rlike(r"^[A-Za-z]:") & ~path.contains("\0")


def safe_filename(name: Column, default: str = "download", most: int = 120) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1F<>:"/\\|?*]+', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", default).otherwise(F.left(clean, F.lit(most)))


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version, padded to four; parts that aren't numbers count 0."""
    parts = F.transform(F.split(F.regexp_replace(version, "^[vV]", ""), "[.]"), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)


def compare_versions(a: Column, b: Column) -> Column:
    x, y = version_parts(a), version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def roman_or_decimal(folio: Column) -> Column:
    """The number of a printed page label in digits or well-formed Roman numerals; null for others."""
    low = F.lower(F.trim(folio))
    value = F.create_map(*[F.lit(x) for pair in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in pair])
    digits = F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(value, c), F.lit(0)))
    signed = let(digits, lambda d: F.transform(d, lambda v, i: F.when(v < F.coalesce(F.get(d, i + 1), F.lit(0)), -v).otherwise(v)))
    roman = F.aggregate(signed, F.lit(0), lambda a, v: a + v)
    return F.when(low.rlike("^[0-9]{1,9}$"), low.try_cast("int")).when((low != "") & low.rlike("^m*(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"), roman)


def page_range(spec: Column, total: Column) -> Column:
    """Pages of a specification such as ``1-3,7``, distinct, in order, within ``total``; null if any part can't be read."""
    parts = F.transform(F.split(F.regexp_replace(spec, r"\s+", ""), ","), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 1).try_cast("int").alias("a"), F.regexp_extract(p, r"^(\d+)-(\d+)$", 2).try_cast("int").alias("b")))
    bad = F.exists(parts, lambda p: p.a.isNull() | (p.a < 1) | (F.coalesce(p.b, p.a) < p.a) | (F.coalesce(p.b, p.a) > total))
    pages = F.transform(parts, lambda p: F.sequence(p.a, F.greatest(F.coalesce(p.b, p.a), p.a)))
    return F.when(~bad, F.array_sort(F.array_distinct(F.flatten(pages))))


def redact_secrets(text: Column) -> tuple[Column, Column]:
    """The text with keys, tokens and local paths taken out, and how many."""
    pattern = r"""(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)["']?[A-Za-z0-9_\-]{8,}["']?"""
    path = r"(/home/|/Users/|[A-Z]:\\Users\\)[^\s\"']+"
    return F.regexp_replace(F.regexp_replace(text, pattern, "$1[redacted]"), path, "[path]"), F.regexp_count(text, F.lit(pattern)) + F.regexp_count(text, F.lit(path))


def terminal_status(value: Column, verified: Column) -> Column:
    """One vocabulary for how a run ended."""
    low = F.lower(F.trim(value))
    return (
        F.when(low.isin("done", "complete", "completed", "success", "succeeded"), F.when(verified, "completed").otherwise("needs_review"))
        .when(low.isin("cancelled", "canceled", "aborted"), "cancelled")
        .when(low.isin("failed", "error"), "failed")
        .otherwise("unknown")
    )


def confusables(text: Column) -> Column:
    """Letters of another script inside Latin words, and invisible characters."""
    return F.regexp_extract_all(text, F.lit(r"((?<=\p{IsLatin})[\p{IsGreek}\p{IsCyrillic}]|[\u200B-\u200F\u2060\uFEFF])"), F.lit(1))


def reference_tokens(text: Column) -> Column:
    """``kind:number`` for every mention such as ``Theorem 2.1`` or ``Fig. 3``."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(theorem|lemma|figure|fig\.|table|section|equation|eq\.)\s+\d+(?:\.\d+)*"), F.lit(0))
    kind = lambda t: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(t, r"^(\S+)", 1)), r"^fig\.$", "figure"), r"^eq\.$", "equation")
    return F.transform(found, lambda t: F.concat(kind(t), F.lit(":"), F.regexp_extract(t, r"(\d+(?:\.\d+)*)$", 1)))


def pack_metadata(json: Column, name: str = "outline") -> Column:
    """JSON as one comment line, in URL-safe base64 without padding."""
    packed = F.regexp_replace(F.base64(json.cast("binary")), r"[\r\n=]", "")
    return F.concat(F.lit(f"% {name}: "), F.translate(packed, "+/", "-_"))


def unpack_metadata(line: Column, name: str = "outline") -> Column:
    """The JSON of a comment line; null for others."""
    packed = F.translate(F.regexp_extract(line, rf"^% {name}: ([A-Za-z0-9_-]+)$", 1), "-_", "+/")
    return F.when(packed != "", F.unbase64(F.rpad(packed, (F.ceil(F.length(packed) / 4) * 4).cast("int"), "=")).cast("string"))


def usage(fields: dict[str, list[Column]]) -> dict[str, Column]:
    """input, cached, output and total tokens from the names that providers use: the first that is there; none below 0, cached at most input."""
    first = {k: F.greatest(F.lit(0), F.coalesce(*[c.cast("bigint") for c in v], F.lit(0))) for k, v in fields.items()}
    given = F.coalesce(*[c.cast("bigint") for c in fields["total"]], F.lit(0))
    total = F.when(given > 0, given).otherwise(first["input"] + first["output"])
    return {"input": first["input"], "cached": F.least(first["input"], first["cached"]), "output": first["output"], "total": total}


def words_and_compounds(text: Column) -> Column:
    """Lower-case words and, beside their parts, words joined by hyphens."""
    low = F.lower(text)
    plain = F.regexp_extract_all(low, F.lit(r"([\p{L}]+)"), F.lit(1))
    return F.concat(plain, F.regexp_extract_all(low, F.lit(r"([\p{L}]+(?:-[\p{L}]+)+)"), F.lit(1)))


def break_verdict(joined: Column, hyphenated: Column, least: int = 2) -> Column:
    """Whether a hyphen at a line's end belongs to the word, by how often the corpus has either form."""
    return F.when((joined >= least) & (hyphenated == 0), "JOIN").when((hyphenated >= least) & (joined == 0), "KEEP").otherwise("AMBIGUOUS")


def clean_text(text: Column, most: int | None = None) -> Column:
    """White space once, control characters out, spacing accents composed with the letter in front; on request cut for a hint."""
    out = collapse_space(F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", " "))
    return out if most is None else F.left(out, F.lit(most))
