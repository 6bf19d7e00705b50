"""Set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import below


def replace_by_key(base: DataFrame, newer: DataFrame, on: list[str]) -> DataFrame:
    return below(base.join(newer, on, "left_anti"), newer, keys=on)


def disjoint(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted keys that aren't rejected."""
    return accepted.subtract(rejected)


def presence(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys with ``side``: both, left or right."""
    a, b = left.select(*on).distinct().withColumn("_a", F.lit(1)), right.select(*on).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, on, "full_outer").select(*on, side.alias("side"))


def same_sets(left: Column, right: Column) -> Column:
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def path_collisions(paths: DataFrame, path: str) -> DataFrame:
    """Paths that differ in case alone, and paths that are a folder of another one, with the reason."""
    low = F.lower(path)
    cased = paths.select(low.alias("p"), F.col(path).alias("own")).groupBy("p").agg(F.count_distinct("own").alias("n")).filter("n > 1").select("p", F.lit("case").alias("reason"))
    parts = F.split(low, "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > i, F.array_join(F.slice(parts, 1, i), "/")))).alias("p"))
    folders = folders.filter("p IS NOT NULL").distinct()
    files = paths.select(low.alias("p")).distinct()
    return below(cased, files.join(folders, "p", "left_semi").select("p", F.lit("folder").alias("reason")), keys=["p"])


def set_digest(rows: DataFrame, key: str, member: str) -> DataFrame:
    """key, number of distinct members and SHA-256 of them, sorted and joined by newlines."""
    out = rows.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("m"))
    return out.select(key, F.size("m").alias("n_members"), F.sha2(F.array_join("m", "\n"), 256).alias("sha256"))
