"""Queries over records: metadata codecs, path safety, contiguity, one-to-one matches, runs, collisions, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import edits, lines, multisets, sampling
from ..sources import files
from ._base import Queries, table

Q = Queries()


@Q.add("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, to_base64(encode('{\"event\":' || event_id || ',\"k\":' || CAST(json_extract(props, '$.k') AS INT) || '}')) AS packed FROM events")
def metadata_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata packed as base64 JSON, read back from there."""
    packed = F.base64(F.to_json(F.struct(F.col("event_id").alias("event"), F.from_json("props", "k INT")["k"].alias("k"))).cast("binary"))
    rows = table(spark, sf_dir, "events").select(F.regexp_replace(packed, "\\s", "").alias("packed"))
    meta = F.from_json(F.unbase64("packed").cast("string"), "event BIGINT, k INT")
    return rows.select(meta["event"].alias("event_id"), meta["k"].alias("k"), "packed")


@Q.add(r"""SELECT page_id, NOT (regexp_matches(p, '^[A-Za-z]:') OR len(list_filter(string_split_regex(p, '[/\\]'), lambda x: x IN ('', '.', '..'))) > 0) AS safe
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1)[2:] AS p FROM pages)""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("substring(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1), 2)")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_path(path).alias("safe"))


@Q.add("""WITH r AS (SELECT conv_id, turn - (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS d FROM conversations)
SELECT conv_id, min(d) = 0 AND max(d) = 0 AS contiguous FROM r GROUP BY conv_id""")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - (F.row_number().over(w) - 1)).alias("d"))
    return rows.groupBy("conv_id").agg(((F.min("d") == 0) & (F.max("d") == 0)).alias("contiguous"))


@Q.add("""WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang = 'fr')
SELECT a.source, a.doc_id, b.doc_id AS matched FROM a LEFT JOIN b ON a.source = b.source AND a.k = b.k""")
def kth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = docs.filter("lang = 'en'").select("source", "doc_id")
    right = docs.filter("lang = 'fr'").select("source", F.col("doc_id").alias("matched"))
    return multisets.kth_match(left, right, ["source"], ["doc_id"], ["matched"])


@Q.add("""WITH s AS (SELECT user_id, event_id, ts, event_type = 'view' AS s FROM events), n AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n), e AS (SELECT *, least(row_number() OVER (PARTITION BY user_id, run ORDER BY event_id), row_number() OVER (PARTITION BY user_id, run ORDER BY event_id DESC)) AS e FROM r)
SELECT user_id, event_id FROM e WHERE NOT s OR e <= 1""")
def compact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sampling.compact_runs(rows, "user_id", "event_id", F.col("event_type") == "view", 1).select("user_id", "event_id")


@Q.add("""WITH o AS (SELECT l_orderkey AS doc, l_partkey % 5 AS line, l_suppkey AS new FROM lineitem), d AS (SELECT DISTINCT * FROM o)
SELECT doc, line, any_value(new) AS new FROM d GROUP BY doc, line HAVING count(*) = 1""")
def single_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of which no different one touches the same line."""
    ops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 5).alias("line"), F.col("l_suppkey").alias("new"))
    return edits.single_edit_lines(ops, "doc")


@Q.add("""SELECT '{"c_acctbal_cents":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS value FROM customer""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("c_acctbal_cents"))
    return files.canonical_json(rows)


@Q.add("""WITH b AS (SELECT user_id, CAST(event_id % 100 AS DOUBLE) AS x0, CAST(event_id % 37 AS DOUBLE) AS y0, CAST(event_id % 100 + 10 AS DOUBLE) AS x1, CAST(event_id % 37 + 5 AS DOUBLE) AS y1 FROM events)
SELECT user_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(CASE WHEN x1 / 110 <= 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_left FROM b GROUP BY user_id""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") % 100).cast("double"), (F.col("event_id") % 37).cast("double")
    rows = table(spark, sf_dir, "events").select("user_id", x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 5).alias("y1"))
    side = G.tag_side(F.col("x0") / 110, F.col("x1") / 110)
    return rows.groupBy("user_id").agg(*G.union(), F.sum(F.when(side == "left", 1).otherwise(0)).alias("n_left"))


@Q.add("""WITH m AS (SELECT conv_id, string_agg('%% page ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, sha256(t) AS sha256, CAST(length(t) AS INT) AS n FROM m""")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = lines.merge_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return merged.select("conv_id", F.sha2("text", 256).alias("sha256"), F.length("text").alias("n"))


@Q.add("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
SELECT o_custkey, o_orderkey, datediff('day', o_orderdate, nxt) AS days FROM s""")
def next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each order's span lasts: until the next one starts."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff(F.lead("o_orderdate").over(w).cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", days.cast("bigint").alias("days"))


@Q.add("""WITH f AS (SELECT p_partkey, p_brand || '.' || p_size || '.0' AS v FROM part), x AS (SELECT p_partkey, v, coalesce(TRY_CAST(regexp_extract(split_part(v, '.', 1), '^([0-9]+)', 1) AS INT), 0) AS a, coalesce(TRY_CAST(split_part(v, '.', 2) AS INT), 0) AS b FROM f)
SELECT p_partkey, CASE WHEN (a, b) < (0, 25) THEN -1 WHEN (a, b) > (0, 25) THEN 1 ELSE 0 END AS ord FROM x""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.compare_versions(version, F.lit("0.25")).alias("ord"))


@Q.add("""WITH i AS (SELECT conv_id, turn, role, text FROM conversations), r AS (SELECT conv_id, turn, role, lead(role) OVER w AS n1, lead(role, 2) OVER w AS n2 FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(n1 = 'system', false) OR coalesce(n2 = 'system', false) AS near_system FROM r""")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", lines.look_ahead(F.col("role") == "system", "conv_id", "turn", 2).alias("near_system"))


@Q.add(r"""WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{Greek}\p{Cyrillic}\x{200B}-\x{200F}\x{2060}\x{FEFF}]')) AS INT) AS n, CAST(len(regexp_extract_all(text, '[A-Z]{2,}')) AS INT) AS acronyms FROM documents) SELECT * FROM t""")
def script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.regexp_count("text", F.lit(r"[\p{IsGreek}\p{IsCyrillic}\u200B-\u200F\u2060\uFEFF]"))
    return table(spark, sf_dir, "documents").select("doc_id", odd.alias("n"), F.regexp_count("text", F.lit("[A-Z]{2,}")).alias("acronyms"))
