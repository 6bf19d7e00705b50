"""Plug-ins: template plans of edits, decision models and reviewers. A plug-in is a function over DataFrames or batches; its replies are checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import edits
from .predicates import decisions_fit
from .storage import below, written

TEMPLATES: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def template(name: str) -> Callable:
    """Register a function of (lines, key) that gives operations."""

    def keep(f: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, str], DataFrame]:
        TEMPLATES[name] = f
        return f

    return keep


def _ops(rows: DataFrame, key: str, name: str, kind: str, new=None) -> DataFrame:
    return rows.select(key, F.lit(name).alias("decision"), F.col("line").cast("long").alias("seq"), F.lit(kind).alias("kind"), "line", F.col("text").alias("old"), (F.lit(None).cast("string") if new is None else new).alias("new"))


@template("single-contents")
def single_contents(lines: DataFrame, key: str) -> DataFrame:
    """Deletes every table of contents but the first one that stands alone on its line."""
    own = lines.filter(F.col("text").rlike(r"^\s*\\tableofcontents\s*$"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return _ops(own.withColumn("_n", n).filter("_n > 1"), key, "single-contents", "delete")


@template("no-pagination")
def no_pagination(lines: DataFrame, key: str) -> DataFrame:
    """Deletes page breaks that stand alone on their line."""
    return _ops(lines.filter(F.col("text").rlike(r"^\s*\\(?:newpage|clearpage|cleardoublepage|pagebreak)\s*$")), key, "no-pagination", "delete")


@template("promoted-contents")
def promoted_contents(lines: DataFrame, key: str) -> DataFrame:
    """Lifts contents entries by one level, as sections become chapters."""
    level = F.regexp_extract("text", r"^\s*\\addcontentsline\{toc\}\{(section|subsection|subsubsection)\}", 1)
    up = F.when(level == "section", "chapter").when(level == "subsection", "section").otherwise("subsection")
    new = F.regexp_replace(F.col("text"), F.lit(r"\{toc\}\{[a-z]+\}"), F.concat(F.lit("{toc}{"), up, F.lit("}")))
    return _ops(lines.filter(level != ""), key, "promoted-contents", "replace", new)


def template_ops(lines: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Operations of the templates of these names."""
    return below(*[TEMPLATES[n](lines, key) for n in names], keys=[key])


def applied(lines: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Lines behind the templates' edits; a template whose edits don't fit a document leaves it alone."""
    return edits.apply_ops(lines, edits.valid_ops(template_ops(lines, key, names), lines, key), key)


REPLY = "action string, env string, start int, end int, confidence double"


def decided(candidates: DataFrame, model: Callable[[dict], dict], key: list[str], envs: list[str]) -> DataFrame:
    """Replies of a decision model to candidates (key and further columns, among them ``line``), one call for each, and ``error`` where a reply
    doesn't fit. A model that fails gives an unknown action, and no row is lost."""
    import pandas as pd

    kinds = dict(candidates.dtypes)

    def run(batches):
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                try:
                    said = model(row)
                except Exception as e:  # a reply is data: what a model raises is told in its row
                    said = {"action": f"failed: {e}"}
                out.append([*(row[k] for k in key), *(said.get(c) for c in ("action", "env", "start", "end", "confidence"))])
            frame = pd.DataFrame(out, columns=[*key, "action", "env", "start", "end", "confidence"])
            yield frame.astype({"start": "Int32", "end": "Int32", "confidence": "float64"})

    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + REPLY
    replies = written(candidates.mapInPandas(run, schema), "replies")
    return decisions_fit(replies, candidates, key, envs)


def reviewed(decisions: DataFrame, reviewer: Callable[[DataFrame], DataFrame], key: list[str], rounds: int = 2) -> DataFrame:
    """Decisions after at most ``rounds`` of review. A finding (key, verdict, end) rejects a decision or moves its end; a round without findings is the last."""
    now = decisions
    for _ in range(rounds):
        found = written(reviewer(now).select(*key, "verdict", F.col("end").alias("_end")), "findings")
        if not found.limit(1).count():
            break
        judged = now.join(found, key, "left").filter(~F.col("verdict").eqNullSafe("reject"))
        now = written(judged.withColumn("end", F.coalesce("_end", "end")).drop("verdict", "_end"), "reviewed")
    return now
