"""Detector metrics, threshold sweeps and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(predicted: Column, truth: Column, weight: Column | None = None) -> list[Column]:
    """Counts of pairs, or sums of ``weight`` where a row stands for several."""
    yes, real = F.coalesce(predicted, F.lit(False)), truth
    each = F.lit(1) if weight is None else weight
    total = lambda c: F.coalesce(F.sum(F.when(c, each)), F.lit(0)).cast("long")
    return [total(yes & real).alias("tp"), total(yes & ~real).alias("fp"), total(~yes & real).alias("fn"), total(~yes & ~real).alias("tn")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds ``precision, recall, f1``; each is 0 where it is undefined."""
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = part(F.col("tp"), F.col("tp") + F.col("fp")), part(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), both))


def pair_metrics(pairs: DataFrame, predicted: Column, *by: str) -> DataFrame:
    """Counts and rates of one detector over pairs with a boolean ``is_duplicate``; a column ``n``
    says for how many pairs a row stands."""
    weight = F.col("n") if "n" in pairs.columns else None
    return with_rates(pairs.groupBy(*by).agg(*confusion(predicted, F.col("is_duplicate"), weight)))


def sweep(pairs: DataFrame, thresholds: list, predicted, *by: str) -> DataFrame:
    """The same for each threshold: ``predicted(threshold column)`` decides. Each pair meets
    each of the few thresholds within its row, so nothing but counts is shuffled."""
    kind = "double" if any(isinstance(t, float) for t in thresholds) else "int"
    every = F.array(*[F.lit(t).cast(kind) for t in thresholds])
    return pair_metrics(pairs.withColumn("threshold", F.explode(every)), predicted(F.col("threshold")), "threshold", *by)


def select_radius(scores: DataFrame, minimum_precision: float) -> DataFrame:
    """The row of most recall, then precision, then least threshold, at the precision asked for."""
    able = scores.where(F.col("precision") >= minimum_precision)
    return able.orderBy(F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def accuracy_by_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, n, correct, accuracy`` per true class."""
    counts = rows.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("correct")
    )
    return counts.withColumn("accuracy", F.col("correct") / F.col("n"))
