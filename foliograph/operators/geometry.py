"""Page geometry: lines and regions from words and spans with boxes (x0, y0, x1, y1)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Share of the shorter height by which boxes of one line overlap, at least.
SAME_LINE = 0.58
#: Share of math characters from which a run is a display formula.
DISPLAY = 0.34


def span_runs(spans: DataFrame, page: list[str], is_math: Column, gap: float) -> DataFrame:
    """Runs of math spans of one line: a new run begins at a step to the right of more than ``gap``. Box, spans and text of each."""
    w = Window.partitionBy(*page, "block", "line").orderBy("x0", "span")
    math = spans.filter(is_math)
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap).cast("int"), F.lit(0))
    runs = math.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s.text), "")
    return runs.groupBy(*page, "block", "line", "run").agg(*G.union(), F.count("*").alias("n_spans"), text.alias("text"))


def display_lines(spans: DataFrame, page: list[str], is_math: Column) -> DataFrame:
    """Lines with their share of characters in math spans, and whether they are displays."""
    n = F.length("text")
    out = spans.groupBy(*page, "block", "line").agg(*G.union(), F.sum(n).alias("n_chars"), F.sum(F.when(is_math, n).otherwise(0)).alias("n_math"))
    return out.withColumn("display", F.col("n_math") >= DISPLAY * F.col("n_chars"))


def merge_regions(regions: DataFrame, page: list[str], gap: float) -> DataFrame:
    """Regions of a page joined until none changes: same line and near, or stacked and near. A page's regions are few, so a page is a group."""
    kinds = ", ".join(f"{c} {dict(regions.dtypes)[c]}" for c in page)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        boxes = [list(b) for b in rows[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        changed = True
        while changed:
            changed, out = False, []
            for b in sorted(boxes, key=lambda b: (b[1], b[0])):
                for o in out:
                    height = min(b[3] - b[1], o[3] - o[1])
                    level = min(b[3], o[3]) - max(b[1], o[1]) >= SAME_LINE * height and max(b[0], o[0]) - min(b[2], o[2]) <= gap
                    stacked = min(b[2], o[2]) > max(b[0], o[0]) and 0 <= max(b[1], o[1]) - min(b[3], o[3]) <= gap
                    if level or stacked:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
                        changed = True
                        break
                else:
                    out.append(b)
            boxes = out
        return pd.DataFrame([[*key, *b] for b in sorted(boxes, key=lambda b: (b[1], b[0]))], columns=[*page, "x0", "y0", "x1", "y1"])

    return regions.groupBy(*page).applyInPandas(run, f"{kinds}, x0 double, y0 double, x1 double, y1 double")


def equation_tags(words: DataFrame, page: list[str], widths: DataFrame) -> DataFrame:
    """Words such as ``(2.1)`` in a margin, with the margin's side; the evidence counts if all of a page's are on one side."""
    tagged = words.filter(F.col("text").rlike(r"^\(\d+(?:\.\d+)*[a-z]?\)$")).join(widths, page)
    tagged = tagged.withColumn("side", G.tag_side(F.col("x0") / F.col("width"), F.col("x1") / F.col("width"))).filter("side <> 'unknown'")
    sides = F.size(F.collect_set("side").over(Window.partitionBy(*page)))
    return tagged.withColumn("uniform", sides == 1).withColumn("label", F.regexp_extract("text", r"^\((.*)\)$", 1)).drop("width")


def footnotes(spans: DataFrame, page: list[str], heights: DataFrame, rules: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Lines below a page's lowest rule in its lower half whose letters are smaller than ``ratio`` of the page's most used size."""
    mode = weighted_mode(spans, page, "size", F.length("text")).withColumnRenamed("mode", "body_size")
    lowest = rules.join(heights, page).filter(F.col("y0") > F.col("height") / 2).groupBy(*page).agg(F.max("y0").alias("rule_y"))
    rows = spans.join(mode, page).join(lowest, page).filter((F.col("y0") > F.col("rule_y")) & (F.col("size") < F.col("body_size") * ratio))
    return rows.groupBy(*page, "block", "line").agg(*G.union(), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s.text), "").alias("text"))


def framed_regions(drawings: DataFrame, page: list[str], width: float, height: float) -> DataFrame:
    """Drawn boxes of at least this size that no other box of the page holds."""
    big = drawings.filter((F.col("x1") - F.col("x0") >= width) & (F.col("y1") - F.col("y0") >= height))
    outer = big.select(*page, *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    same = [big[c] == outer[c] for c in page]
    holds = (F.col("o_x0") <= F.col("x0")) & (F.col("o_y0") <= F.col("y0")) & (F.col("o_x1") >= F.col("x1")) & (F.col("o_y1") >= F.col("y1"))
    larger = (F.col("o_x1") - F.col("o_x0")) * (F.col("o_y1") - F.col("o_y0")) > (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    on = holds & larger
    for s in same:
        on = on & s
    return big.join(outer, on, "left_anti")


def style_runs(spans: DataFrame, page: list[str]) -> DataFrame:
    """Runs of neighbouring spans of one font and size in a line: box, font, size, spans and text."""
    w = Window.partitionBy(*page, "block", "line").orderBy("x0", "span")
    style = F.struct("font", "size")
    new = F.coalesce((F.lag(style).over(w) != style).cast("int"), F.lit(0))
    runs = spans.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "span", "text"))), lambda s: s.text), "")
    return runs.groupBy(*page, "block", "line", "run", "font", "size").agg(*G.union(), F.count("*").alias("n_spans"), text.alias("text"))


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """by and ``mode``: the value (to one digit) with the greatest weight, the larger one of equals."""
    sums = rows.groupBy(*by, F.round(value, 1).alias(value)).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*by).agg(F.max_by(value, F.struct("_w", value)).alias("mode"))


def font_inventory(spans: DataFrame) -> DataFrame:
    return spans.groupBy("font").agg(F.count("*").alias("n_spans"), F.sort_array(F.collect_set("page")).alias("pages"), F.count_distinct("page").alias("n_pages"))


def page_fidelity(source: DataFrame, generated: DataFrame, offset: int, similarity: Column) -> DataFrame:
    """Source page i against generated page i + offset: page and similarity, null where the page is missing."""
    right = generated.select((F.col("page") - offset).alias("page"), F.col("text").alias("generated_text"))
    return source.join(right, "page", "left").withColumn("similarity", F.when(F.col("generated_text").isNotNull(), similarity))


def chapter_means(pages: DataFrame, chapters: DataFrame, last_page: int) -> DataFrame:
    """Mean and least similarity of each chapter's pages; a chapter ends where the next begins."""
    ends = chapters.withColumn("end_page", F.coalesce(F.lead("start_page").over(Window.orderBy("start_page")) - 1, F.lit(last_page)))
    joined = pages.join(F.broadcast(ends), F.col("page").between(F.col("start_page"), F.col("end_page")))  # a book's chapters
    return joined.groupBy("number").agg(F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.min("similarity"), 6).alias("least"), F.count("*").alias("n_pages"))
