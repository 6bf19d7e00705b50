"""Rates and bounds as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 97.5 % quantile of the normal distribution; a fixed value.
Z95 = 1.959963984540054


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision and recall are 1 with an empty denominator, F1 is 0 if both are 0; rounded to 4 digits."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)}


def wilson_lower(successes: Column, total: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson interval; 0 without trials."""
    n = total.cast("double")
    p = successes / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), low)).otherwise(F.lit(0.0))


def valid_confidence(value: Column) -> Column:
    """A number from 0 to 1; NaN, infinities and null aren't."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & value.between(0.0, 1.0), F.lit(False))
