"""Lines, blocks and what stands before or after them. A document's rows carry its id; orders are explicit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_comment, normalise_newlines, sums_before


def line_starts(lines: Column) -> Column:
    """Code points in front of each line."""
    return sums_before(F.transform(lines, lambda x: (F.length(x) + 1).cast("bigint")))


def explode_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """key, line (from 1) and text of every line; on request start_off (code points from 0). Nothing is shuffled."""
    lines = F.split(normalise_newlines(F.col(text)), "\n")
    if not offsets:
        return documents.select(key, F.posexplode(lines).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")
    rows = documents.select(key, lines.alias("_lines"))
    zipped = F.arrays_zip(F.col("_lines").alias("text"), line_starts(F.col("_lines")).alias("start_off"))
    exploded = rows.select(key, F.posexplode(zipped).alias("pos", "row"))
    return exploded.select(key, (F.col("pos") + 1).alias("line"), F.col("row")["start_off"].cast("int").alias("start_off"), F.col("row")["text"].alias("text"))


def with_masked(lines: DataFrame, marker: str = "%") -> DataFrame:
    return lines.withColumn("masked", mask_comment(F.col("text"), marker))


def blocks(lines: DataFrame, is_break: Column, key: str = "doc_id", order: str = "line") -> DataFrame:
    """Maximal runs of rows that are no break: key, block_id (from 0), start, end, n_lines."""
    w = Window.partitionBy(key).orderBy(order)
    marked = lines.withColumn("_break", is_break).withColumn("_group", F.sum(F.col("_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.filter(~F.col("_break")).groupBy(key, "_group").agg(F.min(order).alias("start_line"), F.max(order).alias("end_line"), F.count("*").alias("n_lines"))
    return runs.withColumn("block_id", F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1).drop("_group")


def last_before(rows: DataFrame, value: Column, key: str, order: list[str], name: str, inclusive: bool = True) -> DataFrame:
    """As-of: the last non-null ``value`` up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_after(rows: DataFrame, value: Column, key: str, order: list[str], name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(value, ignorenulls=True).over(w))


def extend_until(rows: DataFrame, is_stop: Column, key: str, order: str) -> DataFrame:
    """Rows in front of the first stop of each key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_stopped", F.max(is_stop.cast("int")).over(w)).filter("_stopped = 0").drop("_stopped")


def look_ahead(flag: Column, key: str, order: str, n: int) -> Column:
    """Whether the flag holds in one of the next ``n`` rows."""
    return F.coalesce(F.max(flag.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(1, n)), F.lit(0)) > 0


def merge_pages(pages: DataFrame, key: str, page: str, text: str, marker: str = "%% page ", meta: Column | None = None) -> DataFrame:
    """One text of all pages in order, each behind a marker line; on request under a comment line of metadata."""
    rows = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, text))).alias("p"), *([F.first(meta).alias("_meta")] if meta is not None else []))
    merged = F.array_join(F.transform("p", lambda x: F.concat(F.lit(marker), x[page].cast("string"), F.lit("\n"), x[text])), "\n")
    return rows.select(key, (F.concat("_meta", F.lit("\n"), merged) if meta is not None else merged).alias("text"))


def section_paths(headings: DataFrame, key: str, order: str, level: str, title: str, levels: int = 4) -> DataFrame:
    """Titles from outer to inner at each heading: per level the last title that no shallower heading came after."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(levels):
        at = F.max(F.when(F.col(level) == k, F.col(order))).over(w)
        shallower = F.max(F.when(F.col(level) < k, F.col(order))).over(w)
        name = F.last(F.when(F.col(level) == k, F.col(title)), ignorenulls=True).over(w)
        parts.append(F.when((F.col(level) >= k) & (shallower.isNull() | (at > shallower)), name))
    return headings.withColumn("section_path", F.array_compact(F.array(*parts)))
