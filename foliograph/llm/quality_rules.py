"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base counts of each text are taken in one pass and written as a narrow table. Mergeable quantile sketches
(``percentile_approx``; partial sketches are merged, so a hot source costs no more than its rows) give quartiles of each
measure per language and source, per language, and overall. A limit is ``q50 + FENCE * (2 * (q50 - q25) + RESOLUTION)``:
the lower half of a group gives its spread, so junk moves a limit only where it is half of the group. The narrowest group
with at least ``MIN_GROUP`` texts sets the limit, but no source goes beyond the median limit of the sources of its language
(of all sources, if the language has fewer than ``MIN_SOURCES``), each source counting once: a source of junk can't let
itself through, however many rows it has. The limits are joined back to the measures and a text is kept if it passes the
base rules and no measure is above its limit.

Defined cases: a null text has no words and all counts 0, fails the base rules and is kept out of the sketches, as every
text that fails them is; null lang or source is a group of its own; groups below MIN_GROUP use the next wider one; an empty
table gives no rows; repeated rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SEPARATORS, let, materialise, table

#: Limits where the whole table has fewer than MIN_GROUP texts.
FLOORS = {"symbol_rate": 0.10, "dup_line_rate": 0.30, "repeat_rate": 0.35, "mean_word_chars": 8.0, "upper_rate": 0.30, "pipe_rate": 0.12}
#: Added to a group's spread: most texts have none of what is measured, and their quartiles are equal.
RESOLUTION = {"symbol_rate": 0.01, "dup_line_rate": 0.05, "repeat_rate": 0.055, "mean_word_chars": 0.15, "upper_rate": 0.01, "pipe_rate": 0.01}
FENCE = 6.0
MIN_GROUP = 50
MIN_SOURCES = 3
#: Rank error of a sketch is at most 1 / ACCURACY of its rows.
ACCURACY = 10_000


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        starts = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: same(s, e, k - 1) | same(s, e, k + 1)), lambda e: e["i"])))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x
            ),
        )

    windows = let(
        words,
        lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
    )
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SEPARATORS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    drop = lambda t, chars: F.translate(t, chars, "")
    rows = documents.select("doc_id", "lang", "source", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(drop(F.col("text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(drop(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(drop(F.col("text"), "|"))).cast("long").alias("n_pipes"),
    )


def measures(counts: DataFrame) -> DataFrame:
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_rate": rate("n_symbols", "word_chars"),
            "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"),
            "mean_word_chars": rate("word_chars", "n_words"),
            "upper_rate": rate("n_upper", "word_chars"),
            "pipe_rate": rate("n_pipes", "n_words"),
        }
    )


def thresholds(measured: DataFrame, by: list[str], name: str, fence: float, accuracy: int, min_group: int = MIN_GROUP) -> DataFrame:
    """Limits per group ``by``, as struct column ``name``; groups below ``min_group`` are left to a wider level."""
    quartiles = [F.percentile_approx(m, [0.25, 0.5], accuracy).alias(m) for m in FLOORS]
    sketched = measured.filter(~F.col("base_failed")).groupBy(*by).agg(F.count("*").alias("n"), *quartiles)
    limits = [(F.col(m)[1] + fence * (2 * (F.col(m)[1] - F.col(m)[0]) + F.lit(RESOLUTION[m]))).alias(m) for m in FLOORS]
    return sketched.filter(F.col("n") >= min_group).select(*[F.col(c).alias(f"_{name}_{c}") for c in by], F.struct(*limits).alias(name))


def of_sources(by_source: DataFrame, by: list[str], name: str, accuracy: int, min_sources: int = MIN_SOURCES) -> DataFrame:
    """The median of the sources' limits per group ``by``, as struct column ``name``; none for groups below ``min_sources``."""
    rows = by_source.groupBy(*[F.col(f"_by_source_{c}").alias(f"_{name}_{c}") for c in by])
    limits = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(f"by_source.{m}", 0.5, accuracy).alias(m) for m in FLOORS])
    return limits.filter(F.col("n") >= min_sources).select(*[f"_{name}_{c}" for c in by], F.struct(*FLOORS).alias(name))


def apply_rules(documents: DataFrame, fence: float = FENCE, accuracy: int = ACCURACY, min_group: int = MIN_GROUP, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Counts, measures, base_failed and kept of every row of ``documents``. ``min_group`` texts have a limit of their own group,
    and ``min_sources`` sources of a language a common limit that none goes beyond."""
    measured = measures(materialise(base_counts(documents), "quality-counts"))
    by_source = materialise(thresholds(measured, ["lang", "source"], "by_source", fence, accuracy, min_group), "quality-limits")
    levels = (
        (["lang", "source"], "by_source", by_source),
        (["lang"], "by_lang", thresholds(measured, ["lang"], "by_lang", fence, accuracy, min_group)),
        ([], "overall", thresholds(measured, [], "overall", fence, accuracy, min_group)),
        (["lang"], "lang_sources", of_sources(by_source, ["lang"], "lang_sources", accuracy, min_sources)),
        ([], "all_sources", of_sources(by_source, [], "all_sources", accuracy, min_sources)),
    )
    out = measured
    for by, name, level in levels:
        if by:
            same = [F.col(c).eqNullSafe(F.col(f"_{name}_{c}")) for c in by]
            out = out.join(level, same, "left").drop(*[f"_{name}_{c}" for c in by])
        else:
            out = out.join(F.broadcast(level), F.lit(True), "left")  # one row at most
    own = F.coalesce("by_source", "lang_sources", "by_lang", "all_sources", "overall")
    most = F.coalesce("lang_sources", "all_sources")
    fine = F.lit(True)
    for m, floor in FLOORS.items():
        fine = fine & (F.col(m) <= F.coalesce(F.least(own[m], most[m]), F.lit(floor)))
    return out.withColumn("kept", ~F.col("base_failed") & fine).drop(*[name for _, name, _ in levels])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_rules(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _level_sql(name: str, by: list[str]) -> str:
    """Limits of groups as in ``thresholds``. A sketch of at most ACCURACY rows is exact, as quantile_disc is."""
    keys = "".join(f"{c}, " for c in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    fences = ", ".join(
        f"quantile_disc({m}, 0.5) + {FENCE!r} * (2 * (quantile_disc({m}, 0.5) - quantile_disc({m}, 0.25)) + {r!r}) AS {m}" for m, r in RESOLUTION.items()
    )
    return f"{name} AS (SELECT * FROM (SELECT {keys}count(*) AS n, {fences} FROM m WHERE NOT base_failed{group}) WHERE n >= {MIN_GROUP})"


def _sources_sql(name: str, by: list[str]) -> str:
    keys = "".join(f"{c}, " for c in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"{name} AS (SELECT * FROM (SELECT {keys}count(*) AS n, {', '.join(f'quantile_disc({m}, 0.5) AS {m}' for m in FLOORS)} FROM s{group}) WHERE n >= {MIN_SOURCES})"


def _fits_sql(m: str, floor: float) -> str:
    # The whole struct of a level is taken or left, so the first level that is there decides; least() passes over nulls.
    own = f"CASE WHEN s.n IS NOT NULL THEN s.{m} WHEN ls.n IS NOT NULL THEN ls.{m} WHEN l.n IS NOT NULL THEN l.{m} WHEN als.n IS NOT NULL THEN als.{m} ELSE o.{m} END"
    most = f"CASE WHEN ls.n IS NOT NULL THEN ls.{m} ELSE als.{m} END"
    return f"m.{m} <= coalesce(least({own}, {most}), {floor!r})"


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT rid, generate_subscripts(words, 1) AS p, unnest(words) AS a FROM w),
g AS (SELECT rid, p AS i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM u WINDOW x AS (PARTITION BY rid ORDER BY p)),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM g WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE c > 1) GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^|]', '', 'g')) AS n_pipes
      FROM w LEFT JOIN r ON w.rid = r.rid),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_rate,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_rate,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_rate,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
        CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_rate,
        CASE WHEN n_words > 0 THEN n_pipes / n_words ELSE 0.0 END AS pipe_rate FROM b),
{_level_sql("s", ["lang", "source"])},
{_level_sql("l", ["lang"])},
{_level_sql("o", [])},
{_sources_sql("ls", ["lang"])},
{_sources_sql("als", [])}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_fits_sql(c, f) for c, f in FLOORS.items())} AS kept
FROM m LEFT JOIN s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source
LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang LEFT JOIN ls ON m.lang IS NOT DISTINCT FROM ls.lang LEFT JOIN o ON true LEFT JOIN als ON true""",
}
