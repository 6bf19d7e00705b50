"""Decisions, reviews and reports as rows: status precedence, exclusions, page quality, summaries, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import below


def decision_items(candidates: DataFrame, decisions: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """Each decision with its candidate's columns and ``status``: excluded goes before applied, rejected and ambiguous; none without a state.

    ``states`` has rows (key, state); a decision may have several.
    """
    order = ["excluded", "applied", "rejected", "ambiguous"]
    rank = F.coalesce(*[F.when(F.col("state") == s, k) for k, s in enumerate(order)])
    best = states.groupBy(*key).agg(F.min_by("state", rank).alias("status"))
    return decisions.join(candidates, key, "left").join(best, key, "left").withColumn("status", F.coalesce("status", F.lit("none")))


def job_view(jobs: DataFrame, private: list[str], status: str = "status", preview: str = "preview") -> DataFrame:
    """Jobs without private columns, with what may be done to each and the size of its preview."""
    s, text = F.col(status), F.coalesce(preview, F.lit(""))
    flags = {
        "preview_ready": text != "",
        "preview_lines": F.regexp_count(text, F.lit("\n")) + 1,
        "preview_chars": F.length(text),
        "can_pause": s.isin("running", "pausing"),
        "can_resume": s == "paused",
        "can_cancel": s.isin("starting", "running", "pausing", "paused"),
    }
    return jobs.withColumns(flags).drop(*private)


def occurrences(found: DataFrame, by: list[str], order: str) -> DataFrame:
    """``occurrence``: how often the row's pair has stood in its document up to here."""
    return found.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def confident(rows: DataFrame, least: float, confidence: str = "confidence") -> DataFrame:
    """Rows with a valid confidence of at least ``least``; NaN, which sorts above all numbers, isn't valid."""
    c = F.col(confidence)
    return rows.filter(c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0) & (c >= least))


def searched(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds the text, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return rows.filter(hit)


def roles(rows: DataFrame, options: dict[str, bool], excluded: dict[str, list[str]], role: str = "role") -> DataFrame:
    """Rows of roles that no option that is off leaves out."""
    out = [r for name, on in options.items() if not on for r in excluded[name]]
    return rows.filter(~F.col(role).isin(out)) if out else rows


def page_quality(pages: DataFrame, jobs: DataFrame, key: str, strict: Column) -> DataFrame:
    """Counts of each job's pages, blockers and warnings (codes, sorted) and ``passed``.

    ``pages`` has key, page, status, low_conf, needs_review, flags (array of struct<needs_review, evidence_id, verified>), regions
    (array of evidence ids) and provenance; ``jobs`` key and status. Pages that aren't done block in any case; the other findings
    block where ``strict`` holds, else they warn.
    """
    flags, c = F.coalesce("flags", F.array().cast("array<struct<needs_review:boolean,evidence_id:string,verified:boolean>>")), F.col
    verified = F.array_distinct(F.transform(F.filter(flags, lambda f: F.coalesce(f["verified"], F.lit(False))), lambda f: f["evidence_id"]))
    regions = F.array_distinct(F.coalesce("regions", F.array().cast("array<string>")))
    review = F.coalesce(c("needs_review"), F.lit(False)) | F.exists(flags, lambda f: F.coalesce(f["needs_review"], F.lit(False)))
    done = F.coalesce(c("status") == "done", F.lit(False))
    marks = {
        "pages_incomplete": ~done,
        "low_confidence": F.coalesce(c("low_conf"), F.lit(False)),
        "needs_review": review,
        "provenance_missing": done & ~F.coalesce(c("provenance").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "inventory_mismatch": (F.size(F.array_except(regions, verified)) > 0) | (F.size(F.array_except(verified, regions)) > 0),
    }
    n = lambda cond: F.count_if(cond)
    counts = pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.sum(F.size(flags)).cast("bigint").alias("n_flags"), *[n(m).alias(f"n_{name}") for name, m in marks.items()])
    rows = jobs.join(counts, key, "left").na.fill(0, ["n_pages", "n_flags", *[f"n_{name}" for name in marks]])
    found = {name: c(f"n_{name}") > 0 for name in marks}
    found["pages_incomplete"] = (c("n_pages") == 0) | (c("status") != "done") | found["pages_incomplete"]
    blocks = lambda name: found[name] if name == "pages_incomplete" else found[name] & strict
    blockers = F.sort_array(F.array_compact(F.array(*[F.when(blocks(m), F.lit(m)) for m in marks])))
    warnings = F.sort_array(F.array_compact(F.array(*[F.when(found[m] & ~blocks(m), F.lit(m)) for m in marks])))
    return rows.withColumns({"blockers": blockers, "warnings": warnings}).withColumn("passed", F.size("blockers") == 0)


def integrity(documents: DataFrame, checks: DataFrame, key: str, ok: Column) -> DataFrame:
    """``state`` of each document's integrity check: exactly one row that is well-formed counts. Checks of unknown documents get rows, too."""
    per = checks.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    rows = documents.select(key).distinct().withColumn("_known", F.lit(True)).join(per, key, "full_outer")
    state = F.when(F.col("_known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("ok"), "valid").otherwise("invalid")
    return rows.select(key, state.alias("state"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how many rows are too many."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("excess", F.col("n") - 1)


def merged_lexicons(*lexicons: DataFrame) -> DataFrame:
    """word and n: counts of several lexicons added; a lexicon is a partial result of the same aggregate."""
    return below(*[x.select("word", "n") for x in lexicons], keys=["word"]).groupBy("word").agg(F.sum("n").alias("n"))


def mean(value: Column, default: float) -> Column:
    return F.coalesce(F.avg(value), F.lit(default))


def marker_counts(texts: DataFrame, key: str, text: str, phrases: list[str], own_spaces: bool = False) -> DataFrame:
    """key, phrase and n: occurrences of whole phrases, the longest first, none inside another.

    With ``own_spaces`` two occurrences of a phrase of several words don't share the space between them: of "in the in the" the second
    is left to shorter phrases.
    """
    import re

    longest = sorted({p.lower() for p in phrases}, key=lambda p: (-len(p), p))
    # Phrases of several words, once found, give way to a private character each, so that nothing shorter is found there again.
    several = {p: chr(0xE000 + k) for k, p in enumerate(p for p in longest if " " in p)}
    marks, word = "".join(several.values()), r"\p{L}\p{N}_"
    rest = F.translate(F.lower(text), marks, "\n" * len(marks))
    for p, mark in several.items():
        own = re.escape(p)
        again = rf"( {own}(?![{word}]))?" if own_spaces else "()"
        rest = F.regexp_replace(rest, rf"{own}(?<![{word}]{own})(?![{word}]){again}", f" {mark} $1")
    single = "|".join(re.escape(p) for p in longest if p not in several)
    pattern = "|".join([*several.values(), *([rf"(?<![{word}])(?:{single})(?![{word}])"] if single else [])])
    counts = texts.select(key, F.explode(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("n"))
    names = [F.when(F.col("phrase") == mark, p) for p, mark in several.items()]
    return counts.withColumn("phrase", F.coalesce(*names, F.col("phrase")))


def strata(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each combination, and of each of its parts."""
    return rows.cube(*by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def in_order(rows: DataFrame, key: str, seq: str, place: list[str]) -> DataFrame:
    """key and whether places never go back along ``seq``."""
    before = F.lag(F.struct(*place)).over(Window.partitionBy(key).orderBy(seq))
    rows = rows.withColumn("_ok", before.isNull() | (before <= F.struct(*place)))
    return rows.groupBy(key).agg(F.bool_and("_ok").alias("ordered"))


def overlapping(rows: DataFrame, key: str, start: str, end: str, ident: str) -> DataFrame:
    """Half-open spans that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy(start, end, ident).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max(end).over(w)).filter(F.col("_reach") > F.col(start)).drop("_reach")


def equal_sequences(left: DataFrame, right: DataFrame, key: str, seq: str, values: list[str]) -> DataFrame:
    """key, equal, n_left and n_right: whether both sides have the same values in the same order."""
    side = lambda d, name: d.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(seq, F.struct(*values).alias("v")))), lambda x: x["v"]).alias(name))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return both.select(key, F.col("l").eqNullSafe(F.col("r")).alias("equal"), F.greatest(n("l"), F.lit(0)).alias("n_left"), F.greatest(n("r"), F.lit(0)).alias("n_right"))


def after_reviews(items: DataFrame, reviews: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """Items with ``excluded`` after reviews (action reject, unreject or reset; a null key means all items), the last that concerns an item wins."""
    own = reviews.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, seq, "action")).alias("_own"))
    all_ = reviews.filter(F.col(key).isNull()).agg(F.max(F.struct(at, seq, "action")).alias("_all"))
    rows = items.join(own, key, "left").join(F.broadcast(all_))  # one row
    last = F.coalesce(F.greatest("_own", "_all"), F.col("_own"), F.col("_all"))
    return rows.withColumn("excluded", F.coalesce(last["action"] == "reject", F.lit(False))).drop("_own", "_all")


#: Words and signs of formulas by class; fixed by notation.
GREEK_WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "pi", "sigma", "phi", "omega", "chi", "kappa", "nu", "rho", "tau"]
NAMED_OPERATORS = ["max", "min", "sup", "inf", "log", "exp", "sin", "cos", "deg", "dim", "mod", "gcd"]


def math_lexemes(text: Column) -> Column:
    """Array of struct(category, value) of a text's numbers, Greek letters and words, operators and single Latin letters, in order."""
    lexeme = r"(?:<=|>=|!=|->|=>|\.\.\.)|\d+(?:\.\d+)*|\p{L}+|[+\-*/=<>^~]"
    value = F.regexp_extract_all(text, F.lit(f"({lexeme})"), F.lit(1))
    low = lambda t: F.lower(t)
    kind = lambda t: (
        F.when(t.rlike(r"^\d"), "numbering").when(t.rlike(r"^\p{IsGreek}+$") | low(t).isin(GREEK_WORDS), "greek").when(low(t).isin(NAMED_OPERATORS) | ~t.rlike(r"^\p{L}"), "operator").when(t.rlike("^[A-Za-z]$"), "identifier")
    )
    return F.filter(F.transform(value, lambda t: F.struct(kind(t).alias("category"), low(t).alias("value"))), lambda s: s["category"].isNotNull())


def report_summary(reports: DataFrame) -> DataFrame:
    """Rates over all reports (tp, fp, fn, unchanged, compiled): sums for the scores, means for the rates; compiled counts where it is known."""
    from ..functions.scoring import precision_recall

    sums = reports.agg(F.count("*").alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg(F.col("unchanged").cast("double")), 4).alias("unchanged_rate"), F.round(F.avg(F.col("compiled").cast("double")), 4).alias("compile_rate"))
    return sums.withColumns(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def declared_gap(documents: DataFrame, required: Column, declared: Column, key: str) -> DataFrame:
    """key and the names that are required and not declared."""
    return documents.select(key, F.array_sort(F.array_except(required, declared)).alias("missing"))


def risk_batches(rows: DataFrame, key: str, order: str, alone: Column, size: int) -> DataFrame:
    """``batch`` of each row in order: a row that must stand alone has a batch to itself and ends the one before, others fill batches of ``size``."""
    w = Window.partitionBy(key).orderBy(order)
    flagged = rows.withColumn("_alone", F.coalesce(alone, F.lit(False)))
    run = F.sum(F.col("_alone").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    flagged = flagged.withColumn("_run", run)
    place = F.row_number().over(Window.partitionBy(key, "_run", "_alone").orderBy(order)) - 1
    part = F.when(F.col("_alone"), F.lit(-1)).otherwise(F.floor(place / size))
    new = flagged.withColumn("_part", part)
    return new.withColumn("batch", F.dense_rank().over(Window.partitionBy(key).orderBy("_run", "_part"))).drop("_alone", "_run", "_part")


def manifest(artifacts: DataFrame, package: str, path: str, content: str, role: str) -> DataFrame:
    """package, n_files, n_bytes, the roles and one digest of the sorted lines ``sha256  role  path`` of what a package holds."""
    line = F.concat_ws("  ", F.sha2(content, 256), F.col(role), F.col(path))
    rows = artifacts.groupBy(package).agg(F.count("*").alias("n_files"), F.sum(F.octet_length(content)).cast("bigint").alias("n_bytes"), F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"), F.sort_array(F.collect_list(F.struct(path, line.alias("line")))).alias("_l"))
    return rows.withColumn("sha256", F.sha2(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), 256)).drop("_l")


REPLY_SCHEMA = "id STRING, action STRING, env STRING, start INT, end INT, confidence DOUBLE"


def normalised_replies(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """key, the fields of each JSON reply and ``error``: not an object, a field that is missing or of another kind, an environment beside an action that
    takes none, a range that is no range. Nothing is guessed: a reply with an error keeps its fields for the report."""
    parsed = F.from_json(json, REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(json)
    lacks = F.array_except(F.array(*[F.lit(c) for c in ("id", "action", "env", "start", "end", "confidence")]), F.coalesce(keys, F.array().cast("array<string>")))
    out = rows.select(*key, parsed.alias("r"), keys.isNotNull().alias("_object"), lacks.alias("_lacks")).select(*key, "r.*", "_object", "_lacks")
    error = (
        F.when(~F.col("_object"), "not an object").when(F.size("_lacks") > 0, F.concat(F.lit("without "), F.array_join("_lacks", ",")))
        .when(F.col("start").isNull() | F.col("end").isNull() | F.col("confidence").isNull(), "a field of another kind").when(~F.col("action").isin("wrap", "move-boundary") & (F.col("env") != ""), "an environment too many")
        .when(F.col("start") > F.col("end"), "no range").when(~F.col("confidence").between(0.0, 1.0), "no confidence")
    )
    return out.withColumn("error", error).drop("_object", "_lacks")
