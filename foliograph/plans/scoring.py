"""Queries that score rules and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import precision_recall, wilson_lower
from ..operators import evaluate, keysets, sampling
from ._base import Queries, table

Q = Queries()

RULE = "r AS (SELECT d.doc_id, d.lang, d.source, l.quality = 0 AS gold, contains(d.text, '!!') OR contains(d.text, ' | ') OR contains(d.text, '***') AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
COUNTS = "CAST(sum(CAST(gold AND said AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(NOT gold AND said AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(gold AND NOT said AS INT)) AS BIGINT) AS fn"
RATES = "round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1"


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for low quality against the labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    said = F.col("text").contains("!!") | F.col("text").contains(" | ") | F.col("text").contains("***")
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 0).alias("gold"), said.alias("said"))


@Q.add(f"""WITH {RULE}, c AS (SELECT lang, source, {COUNTS} FROM r GROUP BY GROUPING SETS ((lang), (source), ())),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM c) SELECT lang, source, tp, fp, fn, {RATES} FROM m""")
def key_set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled(spark, sf_dir).createOrReplaceTempView("foliograph_ruled")
    n = lambda c, name: f"sum(CAST({c} AS INT)) AS {name}"
    counts = spark.sql(
        f"SELECT lang, source, {n('gold AND said', 'tp')}, {n('NOT gold AND said', 'fp')}, {n('gold AND NOT said', 'fn')} FROM foliograph_ruled GROUP BY GROUPING SETS ((lang), (source), ())"
    )
    return counts.withColumns(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


_W = "((n1 / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(n1 / n * (1 - n1 / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n))"


@Q.add(f"WITH c AS (SELECT d.lang, CAST(sum(l.quality) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang) SELECT lang, CAST(n1 AS BIGINT) AS good, CAST(n AS BIGINT) AS n, round(greatest(0.0, {_W}), 6) AS lower FROM c")
def wilson_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return rows.withColumn("lower", F.round(wilson_lower(F.col("good"), F.col("n")), 6))


def units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold units from documents, and replies with wrong, missing, repeated, malformed and unknown ones in them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    auto = F.col("doc_id") % 3 == 0
    action = F.when(auto, "wrap").when(F.col("doc_id") % 3 == 1, "preserve").otherwise("manual")
    gold = d.select(F.col("doc_id").alias("id"), F.col("source").alias("document"), action.alias("action"), F.when(auto, "note").otherwise("").alias("env"), F.col("doc_id").alias("start_block"), (F.col("doc_id") + F.col("n_chars") % 4).alias("end_block"))
    wrong = F.col("id") % 11 == 5
    said = gold.filter("id % 17 <> 3").select("id", F.when(F.col("id") % 23 == 7, "other").when(wrong, "wrap").otherwise(F.col("action")).alias("action"), F.when(wrong, "note").otherwise(F.col("env")).alias("env"), "start_block", (F.col("end_block") + F.when(F.col("id") % 13 == 6, 1).otherwise(0)).alias("end_block"))
    return gold, said.unionByName(said.filter("id % 29 = 4")).unionByName(said.filter("id % 31 = 2").withColumn("id", F.col("id") + 10_000_000))


UNITS = """g AS (SELECT doc_id AS id, source AS document, CASE doc_id % 3 WHEN 0 THEN 'wrap' WHEN 1 THEN 'preserve' ELSE 'manual' END AS action, CASE doc_id % 3 WHEN 0 THEN 'note' ELSE '' END AS env, doc_id AS s, doc_id + n_chars % 4 AS e FROM documents),
p0 AS (SELECT id, CASE WHEN id % 23 = 7 THEN 'other' WHEN id % 11 = 5 THEN 'wrap' ELSE action END AS action, CASE WHEN id % 11 = 5 THEN 'note' ELSE env END AS env, s, e + CASE WHEN id % 13 = 6 THEN 1 ELSE 0 END AS e FROM g WHERE id % 17 <> 3),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE id % 29 = 4 UNION ALL SELECT id + 10000000, action, env, s, e FROM p0 WHERE id % 31 = 2),
c AS (SELECT id, count(*) AS n, any_value(action) AS pa, any_value(env) AS pe, any_value(s) AS ps, any_value(e) AS pz FROM p GROUP BY id),
j AS (SELECT g.*, c.pa, c.pe, c.ps, c.pz, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'duplicate' WHEN pa IN ('wrap', 'move-boundary', 'preserve', 'manual') AND (pa IN ('wrap', 'move-boundary') OR pe = '') AND ps <= pz THEN 'valid' ELSE 'malformed' END AS state FROM g LEFT JOIN c ON g.id = c.id),
u AS (SELECT *, state = 'valid' AND pa = action AND pe = env AND ps = s AND pz = e AS ok, action = 'wrap' AS ga, state = 'valid' AND pa = 'wrap' AS sa FROM j)"""
SCORES = """t AS (SELECT document, count(*) AS units, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS exact, CAST(sum(CAST(ga AND ok AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(sa AND NOT ok AS INT)) AS BIGINT) AS fp,
  CAST(sum(CAST(ga AND NOT ok AS INT)) AS BIGINT) AS fn, CAST(sum(CAST(sa AND NOT ga AS INT)) AS BIGINT) AS critical, CAST(sum(CAST(state <> 'valid' AS INT)) AS BIGINT) AS protocol_errors FROM u GROUP BY ROLLUP (document)),
v AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
  round(exact / units, 6) AS exact_rate, round(greatest(0.0, """ + _W.replace("n1 / n", "exact / units").replace("(2 * n)", "(2.0 * units)").replace("/ n + 3", "/ units + 3").replace("(4 * n * n)", "(4.0 * units * units)").replace("/ n))", "/ units))") + "), 6) AS exact_lower FROM t)"


@Q.add(f"WITH {UNITS}, {SCORES} SELECT * FROM v")
def score_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, said = units(spark, sf_dir)
    return evaluate.unit_scores(evaluate.judged(gold, said))


@Q.add(f"WITH {UNITS}, {SCORES} SELECT document, units, exact_rate >= 0.8 AND units >= 10 AND precision >= 0.5 AND recall >= 0.5 AND f1 >= 0.5 AND exact_lower >= 0.5 AND critical = 0 AND protocol_errors = 0 AND exact_rate > 0.8 AS passes FROM v")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.release_gate(score_units(spark, sf_dir), 10, 0.8, 0.5).select("document", "units", "passes")


@Q.add(f"WITH {UNITS} SELECT state, count(*) AS n FROM j GROUP BY state UNION ALL SELECT 'unknown', count(*) FROM p WHERE id NOT IN (SELECT id FROM g)")
def protocol_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, said = units(spark, sf_dir)
    counted = evaluate.judged(gold, said).groupBy("state").agg(F.count("*").alias("n"))
    return counted.unionByName(evaluate.unknown_replies(gold, said).agg(F.lit("unknown").alias("state"), F.count("*").alias("n")))


@Q.add("SELECT CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keysets.presence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("side").agg(F.count("*").alias("n"))


@Q.add("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE lang = 'de'")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    newer = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return keysets.replace_by_key(table(spark, sf_dir, "labels"), newer, ["doc_id"])


@Q.add("SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def accepted_not_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return keysets.disjoint(labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 1").select("doc_id"))


@Q.add("""WITH i AS (SELECT 'blocker' AS severity, doc_id, 'toxic' AS code FROM labels WHERE toxic = 1 UNION ALL SELECT 'review', doc_id, 'quality' FROM labels WHERE quality = 0 UNION ALL SELECT 'diagnostic', doc_id, 'short' FROM documents WHERE n_chars < 100)
SELECT severity, code, doc_id, CAST(row_number() OVER (PARTITION BY severity ORDER BY doc_id) AS INT) AS n FROM i""")
def issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of three severities, numbered in each; the numbers come from ranges, for a severity is a hot group."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    one = lambda d, severity, code: d.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "doc_id")
    rows = one(labels.filter("toxic = 1"), "blocker", "toxic").unionByName(one(labels.filter("quality = 0"), "review", "quality")).unionByName(one(docs.filter("n_chars < 100"), "diagnostic", "short"))
    return sampling.positions(rows, ["severity"], ["doc_id"]).select("severity", "code", "doc_id", F.col("position").cast("int").alias("n"))
