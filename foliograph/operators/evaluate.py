"""Scoring predictions against gold units, with protocol errors, bounds and a release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import f1, precision_recall, ratio, wilson_lower
from .workflow import integrity

AUTOMATIC = ["wrap", "move-boundary"]
ACTIONS = [*AUTOMATIC, "preserve", "manual"]


def judged(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each gold unit with its reply. A unit needs exactly one well-formed reply; missing, repeated and malformed ones are errors."""
    fine = F.col("p_action").isin(ACTIONS) & F.col("p_env").isNotNull() & (F.col("p_action").isin(AUTOMATIC) | (F.col("p_env") == "")) & (F.col("p_start") <= F.col("p_end"))
    replies = predictions.select("id", F.col("action").alias("p_action"), F.col("env").alias("p_env"), F.col("start_block").alias("p_start"), F.col("end_block").alias("p_end"))
    replies = replies.groupBy("id").agg(F.count("*").alias("n_replies"), F.first(F.struct("p_action", "p_env", "p_start", "p_end")).alias("p")).select("id", "n_replies", "p.*")
    out = gold.join(replies, "id", "left").withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))
    state = F.when(F.col("n_replies") == 0, "missing").when(F.col("n_replies") > 1, "duplicate").when(F.coalesce(fine, F.lit(False)), "valid").otherwise("malformed")
    same = F.struct("action", "env", "start_block", "end_block").eqNullSafe(F.struct(F.col("p_action").alias("action"), F.col("p_env").alias("env"), F.col("p_start").alias("start_block"), F.col("p_end").alias("end_block")))
    out = out.withColumn("state", state)
    return out.withColumn("correct", (F.col("state") == "valid") & same)


def unknown_replies(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(gold, "id", "left_anti")


def unit_scores(units: DataFrame, by: str = "document") -> DataFrame:
    """Counts and rates per group and for all (group null). A wrong automatic edit is a false positive and a false negative."""
    gold_auto, said_auto = F.col("action").isin(AUTOMATIC), F.coalesce((F.col("state") == "valid") & F.col("p_action").isin(AUTOMATIC), F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = units.rollup(by).agg(
        F.count("*").alias("units"),
        n(F.col("correct")).alias("exact"),
        n(gold_auto & F.col("correct")).alias("tp"),
        n(said_auto & ~F.col("correct")).alias("fp"),
        n(gold_auto & ~F.col("correct")).alias("fn"),
        n(said_auto & ~gold_auto).alias("critical"),
        n(F.col("state") != "valid").alias("protocol_errors"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns(
        {
            "precision": F.round(ratio(tp, tp + fp), 6),
            "recall": F.round(ratio(tp, tp + fn), 6),
            "f1": F.round(f1(tp, fp, fn), 6),
            "exact_rate": F.round(ratio(F.col("exact"), F.col("units")), 6),
            "exact_lower": F.round(wilson_lower(F.col("exact"), F.col("units")), 6),
        }
    )


def release_gate(scores: DataFrame, least_units: int, exact: float, floor: float) -> DataFrame:
    """The total's row with ``passes``: sizes, rates, bounds, no critical or protocol error, and counts that add up."""
    fits = (F.col("units") >= least_units) & (F.col("exact_rate") > exact)
    for c in ("precision", "recall", "f1", "exact_lower"):
        fits = fits & ~F.isnan(c) & (F.col(c) >= floor)
    fits = fits & (F.col("critical") == 0) & (F.col("protocol_errors") == 0) & (F.col("tp") + F.col("fn") <= F.col("units"))
    return scores.withColumn("passes", fits)


def bound_release(scores: DataFrame, checks: DataFrame, key: str, good: Column) -> DataFrame:
    """Scores with ``integrity`` of the key's check and ``passes``: the score is good and exactly one valid check stands behind it."""
    states = integrity(scores, checks, key, F.col("ok")).withColumnRenamed("state", "integrity")
    return scores.join(states, key).withColumn("passes", good & (F.col("integrity") == "valid"))


def key_metrics(sides: DataFrame, kind: str, env: str) -> DataFrame:
    """Counts and rates of keys with their ``side`` (left: said alone, right: gold alone, both), by kind, by environment and in all."""
    n = lambda s, name: F.sum((F.col("side") == s).cast("int")).cast("bigint").alias(name)
    counts = [n("both", "tp"), n("left", "fp"), n("right", "fn")]
    sets = sides.groupingSets([[F.col(kind)], [F.col(env)], []], kind, env)
    return sets.agg(*counts).withColumns(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
