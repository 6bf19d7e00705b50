"""Interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conflicts(intervals: DataFrame, key: str, order: list[str] | None = None, start: str = "s", end: str = "e") -> DataFrame:
    """Rows that overlap another row of their key (closed intervals); (0, 0) is exempt. Both sides of a conflict are given.

    A sweep: sorted by start, a row overlaps an earlier one iff its start is at or below the running maximum of ends, and a later one iff
    the next row starts at or before its end. One sort per key; a theta self join would cost the square of a key's rows.
    """
    order = [start, end, *(order or [])]
    live = intervals.filter(~((F.col(start) == 0) & (F.col(end) == 0)))
    w = Window.partitionBy(key).orderBy(*order)
    earlier = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col(start)
    later = F.lead(start).over(w) <= F.col(end)
    return live.withColumn("_c", F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))).filter("_c").drop("_c")


def without_conflicts(intervals: DataFrame, key: str, ident: list[str], start: str = "s", end: str = "e") -> DataFrame:
    return intervals.join(conflicts(intervals, key, ident, start, end).select(*ident), ident, "left_anti")


def bucketed_containment(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every range of their key that holds them: ranges are cut into buckets of ``width``, so the join is on (key, bucket)."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    keyed = points.withColumn("_b", F.floor(F.col(at) / width))
    return keyed.join(cut, [key, "_b"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def nearest(rows: DataFrame, is_anchor: Column, key: str, at: str, order: list[str]) -> DataFrame:
    """Each row's last anchor before, first anchor after, and the distance to the nearer; two windows, no join."""
    w = Window.partitionBy(key).orderBy(*order)
    mark = F.when(is_anchor, F.col(at))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = rows.withColumn("before", before).withColumn("after", after)
    return out.withColumn("distance", F.least(F.col(at) - F.col("before"), F.col("after") - F.col(at)))


def gap_sessions(rows: DataFrame, key: str, at: str, order: list[str], gap: Column) -> DataFrame:
    """A session number that grows where the step from the row before is larger than ``gap``."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def tier_lookup(usage: DataFrame, bands: DataFrame, model: str, tokens: str) -> DataFrame:
    """The first price band of the model whose maximum holds the tokens; a null maximum is open. Unknown models get nulls.

    Bands are a dimension of a few rows for each model; Spark broadcasts them if they are small and shuffles on the model if not.
    """
    w = Window.partitionBy("model").orderBy(F.col("max_input_tokens").asc_nulls_last())
    ranged = bands.withColumn("_above", F.coalesce(F.lag("max_input_tokens").over(w), F.lit(-1)))
    ranged = ranged.withColumnRenamed("model", "_model")
    fits = (usage[model] == ranged["_model"]) & (usage[tokens] > ranged["_above"]) & (ranged["max_input_tokens"].isNull() | (usage[tokens] <= ranged["max_input_tokens"]))
    return usage.join(ranged, fits, "left").drop("_model", "_above")
