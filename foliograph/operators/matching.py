"""Ordered matching of an expected outline with found headings. Each choice takes a heading away from later ones, so a document is a group."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .multisets import word_counts


def greedy_outline(expected: DataFrame, headings: DataFrame, key: str, far: int = 1) -> DataFrame:
    """Each outline entry (key, n, title_key, page) and the first unused heading (line, title_key, page) of the same title at most
    ``far`` pages away, by page distance, then line. key, n and line; null where none is left."""
    kind = dict(expected.dtypes)[key]

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        by_title = {t: g for t, g in right.groupby("title_key")}
        for e in left.sort_values("n").itertuples():
            found = by_title.get(e.title_key)
            best = None
            if found is not None:
                fits = [(abs(h.page - e.page), h.line) for h in found.itertuples() if h.line not in used and abs(h.page - e.page) <= far]
                best = min(fits)[1] if fits else None
            if best is not None:
                used.add(best)
            out.append((k[0], e.n, best))
        return pd.DataFrame(out, columns=[key, "n", "line"]).astype({"line": "Int64"})

    return expected.groupBy(key).cogroup(headings.groupBy(key)).applyInPandas(run, f"{key} {kind}, n int, line long")


def ordered_outline(expected: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """The outline walked with a cursor over the headings: key, n, line, level_ok. A heading before the cursor isn't looked at again."""
    kind = dict(expected.dtypes)[key]

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, cursor, out = list(right.sort_values("line").itertuples()), 0, []
        for e in left.sort_values("n").itertuples():
            at = next((i for i in range(cursor, len(rows)) if rows[i].title_key == e.title_key), None)
            out.append((k[0], e.n, None if at is None else rows[at].line, None if at is None else bool(rows[at].level == e.level)))
            cursor = cursor if at is None else at + 1
        return pd.DataFrame(out, columns=[key, "n", "line", "level_ok"]).astype({"line": "Int64", "level_ok": "boolean"})

    return expected.groupBy(key).cogroup(headings.groupBy(key)).applyInPandas(run, f"{key} {kind}, n int, line long, level_ok boolean")


def fuzzy_titles(left: DataFrame, right: DataFrame, block: list[str], score: Column, least: float = 0.93) -> DataFrame:
    """Pairs of a block (page, chapter) whose titles score at least ``least``: the best of each left row, and whether it is the only one."""
    pairs = left.join(right, block).withColumn("score", score).filter(F.col("score") >= least)
    w = Window.partitionBy("left_id")
    ranked = pairs.withColumn("unique", F.count("*").over(w) == 1).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "right_id")))
    return ranked.filter("_n = 1").drop("_n")


def level_jumps(headings: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Headings more than one level below the one before."""
    before = F.lag(level).over(Window.partitionBy(key).orderBy(order))
    return headings.withColumn("_b", before).filter(F.col(level) > F.col("_b") + 1).drop("_b")


def alignment(left: list[str], right: list[str]) -> tuple[int, int]:
    """Tokens that match as multisets and in order."""
    from collections import Counter

    bag = sum((Counter(left) & Counter(right)).values())
    blocks = difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks()
    return bag, sum(b.size for b in blocks)


def aligned(pairs: DataFrame, key: str) -> DataFrame:
    """key, bag, ordered, n_left, n_right of token arrays ``left`` and ``right``."""
    kind = dict(pairs.dtypes)[key]

    def run(batches):
        for rows in batches:
            got = [alignment(list(a), list(b)) for a, b in zip(rows["left"], rows["right"])]
            yield pd.DataFrame({key: rows[key], "bag": [g[0] for g in got], "ordered": [g[1] for g in got], "n_left": rows["left"].map(len), "n_right": rows["right"].map(len)})

    return pairs.select(key, "left", "right").mapInPandas(run, f"{key} {kind}, bag long, ordered long, n_left long, n_right long")


def bag_aligned(pairs: DataFrame, key: str) -> DataFrame:
    """key, bag, n_left, n_right of token arrays ``left`` and ``right``: the multiset part alone, without Python. Distinct words of both
    sides with their counts are sorted together; a word of both stands beside itself."""

    def matched(s: Column) -> Column:
        twice = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.get(s, i - 1)["word"] == F.get(s, i)["word"])
        return F.aggregate(twice, F.lit(0).cast("bigint"), lambda a, i: a + F.least(F.get(s, i - 1)["n"], F.get(s, i)["n"]))

    both = F.sort_array(F.concat(word_counts(F.col("left")), word_counts(F.col("right"))))
    bag = F.when(F.size(both) > 0, let(both, matched)).otherwise(F.lit(0).cast("bigint"))
    return pairs.select(key, bag.alias("bag"), F.size("left").cast("bigint").alias("n_left"), F.size("right").cast("bigint").alias("n_right"))


def alignment_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged F1 of both alignments; the lower one is the score."""
    f = lambda c: F.when(F.sum("n_left") + F.sum("n_right") > 0, 2.0 * F.sum(c) / (F.sum("n_left") + F.sum("n_right"))).otherwise(1.0)
    out = rows.groupBy(*by).agg(F.round(f("bag"), 6).alias("bag_f1"), F.round(f("ordered"), 6).alias("ordered_f1"))
    return out.withColumn("score", F.least("bag_f1", "ordered_f1"))
