"""Deterministic samples and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def priority(*parts: Column, seed: str = "") -> Column:
    """A hash that orders rows the same way everywhere."""
    return F.sha2(F.concat_ws("\u001f", F.lit(seed), *parts), 256)


def positions(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``position`` (from 1) and ``total`` of each row in its group, null keys a group of their own.

    A window over the group would sort a hot group in one task. Rows are range-partitioned by group and order instead, which splits
    large groups, and written, so that ranges stay what they are; a row's position is its place in its range behind the ranges in
    front. Only a count for each range and group is joined.
    """
    ranged = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "positions")
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    ahead = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_ahead": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "total": F.sum("_n").over(w)}).drop("_n")
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_ahead", "total")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    placed = ranged.withColumn("position", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    out = placed.join(counts, same).withColumn("position", F.col("position") + F.col("_ahead"))
    return out.drop("_part", "_p", "_ahead", *[f"_k{i}" for i in range(len(by))])


def thirds(position: Column, total: Column) -> Column:
    """0, 1 or 2 by position (from 1)."""
    return F.least(F.lit(2), F.floor((position - 1) * 3 / total)).cast("int")


def evenly_spaced(rows: DataFrame, order: list[str], k: int, by: list[str]) -> DataFrame:
    """About k rows of each group at even steps; half-way places round to the even one."""
    numbered = positions(rows, by, order)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("total") - 1) / max(1, k - 1)).cast("bigint"))
    return numbered.filter((F.col("total") <= k) | F.array_contains(places, F.col("position") - 1)).drop("position", "total")


def top_by_priority(rows: DataFrame, by: list[str], first: list[Column], k: int) -> DataFrame:
    """The k rows of each group that come first."""
    w = Window.partitionBy(*by).orderBy(*first)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def round_robin(rows: DataFrame, by: str, first: Column, k: int) -> DataFrame:
    """k rows, taking each group's next one in turn."""
    turns = rows.withColumn("_p", first).withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy("_p")))
    return turns.orderBy("turn", "_p").limit(k).drop("_p")


def balanced_batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """A batch number; a group's batches differ by one row at most and hold ``size`` at most."""
    numbered = positions(rows, by, order)
    batches = F.ceil(F.col("total") / size)
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) * batches / F.col("total")).cast("int")).drop("position", "total")


def even_batches(rows: DataFrame, by: list[str], order: list[str], size: int = 4) -> DataFrame:
    """A batch number: batches of two to ``size`` rows (one row alone stays alone), as few as that allows, the larger ones first."""
    numbered = positions(rows, by, order)
    i, n = F.col("position") - 1, F.col("total")
    k = F.greatest(F.lit(1), F.least(F.ceil(n / size), F.floor(n / 2)))
    base, larger = F.floor(n / k), n % k
    batch = F.when(i < larger * (base + 1), F.floor(i / (base + 1))).otherwise(larger + F.floor((i - larger * (base + 1)) / base))
    return numbered.withColumn("batch", batch.cast("int")).drop("position", "total")


def compact_runs(rows: DataFrame, key: str, order: str, same: Column, keep: int = 3) -> DataFrame:
    """Rows without the inner part of long runs where ``same`` holds."""
    w = Window.partitionBy(key).orderBy(order)
    run = rows.withColumn("_s", same).withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(w), ~F.col("_s"))).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(key, "_run")
    ends = F.least(F.row_number().over(r.orderBy(order)), F.row_number().over(r.orderBy(F.desc(order))))
    return run.withColumn("_e", ends).filter(~F.col("_s") | (F.col("_e") <= keep)).drop("_s", "_new", "_run", "_e")
