"""Connected components of an edge table, by alternating star steps.

Each step joins nodes to the least of their neighbours; the edges become stars around the least id of each component. All
steps are joins and partial aggregations over edge rows: neither links nor components reach the driver, and the least
neighbours are written before they are joined, so that a hub's rows can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def _least(edges: DataFrame) -> DataFrame:
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reachable) of every node that has an edge to another node. Null ends are dropped."""
    u, v = F.greatest(a, b), F.least(a, b)
    whole = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    now = materialise(edges.filter(whole).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialise(large, "edges")
        small = large.join(_least(large), "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialise(small.filter("u <> v").distinct(), "edges")
    ends = F.explode(F.array("u", "v"))
    return materialise(now.select(ends.alias("node"), F.col("v").alias("component")).distinct(), "components")


def _stars(edges: DataFrame) -> bool:
    """Whether all edges (u, v), v < u, are stars around their least node: no u has two, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    counts = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return not counts.filter("up > 1 OR (up = 1 AND low = 0)").limit(1).count()


def merged(found: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``components`` of the graph whose components ``found`` has, with further edges: only components that these join are walked."""
    at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    ends = edges.join(at(a), a, "left").join(at(b), b, "left").select(F.coalesce(f"_{a}", a).alias("a"), F.coalesce(f"_{b}", b).alias("b"))
    joined = components(ends).select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = found.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    alone = joined.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))
    return materialise(moved.unionByName(alone), "components")
