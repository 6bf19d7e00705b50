"""Queries over the star schema: tiers and roll-ups, closures, and the relational operations that Spark adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, intervals
from ..operators.storage import below
from ._base import Queries, table

Q = Queries()

BANDS = [("N", 20, 2.0, 8.0), ("N", None, 4.0, 16.0), ("A", 30, 1.0, 3.0), ("A", None, 1.5, 4.5)]
_BANDS = "b(model, hi, lo, i, o) AS (VALUES ('N', 20, -1, 2.0, 8.0), ('N', NULL, 20, 4.0, 16.0), ('A', 30, -1, 1.0, 3.0), ('A', NULL, 30, 1.5, 4.5))"


@Q.add(f"""WITH {_BANDS}, c AS (SELECT l_linestatus AS role, l_returnflag AS model, l_quantity * i + l_linenumber * o AS cost, l_quantity AS tokens FROM lineitem LEFT JOIN b ON l_returnflag = b.model AND l_quantity > b.lo AND (b.hi IS NULL OR l_quantity <= b.hi))
SELECT role, model, CAST(sum(tokens) AS DOUBLE) AS tokens, round(CASE WHEN count(cost) = count(*) THEN CAST(sum(cost) AS DOUBLE) END, 4) AS cost, count(*) AS calls FROM c GROUP BY ROLLUP (role, model)""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiered prices of calls; a total is null as soon as one call has no price."""
    bands = spark.createDataFrame(BANDS, "model string, max_input_tokens int, per_in double, per_out double")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("own_model"), F.col("l_quantity").alias("tokens"), F.col("l_linenumber").alias("out"))
    priced = intervals.tier_lookup(calls, bands, "own_model", "tokens").withColumn("cost", F.col("tokens") * F.col("per_in") + F.col("out") * F.col("per_out"))
    total = F.round(F.when(F.count("cost") == F.count("*"), F.sum("cost")), 4)
    return priced.withColumnRenamed("own_model", "model").rollup("role", "model").agg(F.sum("tokens").alias("tokens"), total.alias("cost"), F.count("*").alias("calls"))


_EDGES = """e AS (SELECT CAST(s_suppkey AS VARCHAR) AS a, CAST(s_suppkey * 2 AS VARCHAR) AS b FROM supplier UNION SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey * 2 + 1 AS VARCHAR) FROM supplier
  UNION SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey // 3 AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-child edges with shared children and edges back up."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    down = s.select(k.cast("string").alias("path"), F.explode(F.array((k * 2).cast("string"), (k * 2 + 1).cast("string"))).alias("target"))
    up = s.filter("s_suppkey % 5 = 0").select(k.cast("string").alias("path"), F.expr("s_suppkey div 3").cast("string").alias("target"))
    return down.unionByName(up).distinct()


@Q.add(f"""WITH RECURSIVE {_EDGES}, w(node, depth) AS (SELECT '1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 30)
SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node""")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a root reaches over include edges, and in how many steps."""
    return graphs.closure(_edges(spark, sf_dir), "1")


@Q.add(f"""WITH RECURSIVE {_EDGES}, r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT DISTINCT a FROM r WHERE a = b),
n AS (SELECT a, b FROM e WHERE a IN (SELECT r.b FROM r JOIN c ON r.a = c.a) AND b IN (SELECT r.a FROM r JOIN c ON r.b = c.a))
SELECT a AS path, b AS target FROM n""")
def include_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on the way between cycles or in one."""
    return graphs.cycles(_edges(spark, sf_dir))


@Q.add("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@Q.add("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small dimensions are broadcast by Spark when their size allows; the large join shuffles on the order key once."""
    t = lambda n: table(spark, sf_dir, n)
    sales = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount"), "o_orderkey")
    rows = sales.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@Q.add("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@Q.add("""SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INT) AS rnk, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS step, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("rnk"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("step"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


@Q.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000 INTERSECT SELECT c_custkey FROM customer")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    idle = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")
    rich = o.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).intersect(c)
    return below(idle, rich, keys=["c_custkey"]).distinct()


@Q.add("SELECT l_shipdate, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_shipdate")
def percentile_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.round(F.percentile("l_extendedprice", 0.9), 4).alias("p90"))
