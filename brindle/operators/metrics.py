"""Rates, confusion figures, gates, histograms and nearest-rank percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import prefix_sum


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn, precision, recall and fpr; ratios with an empty denominator are 0."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tp, fp, fn, tn = n(truth & predicted), n(~truth & predicted), n(truth & ~predicted), n(~truth & ~predicted)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr")]


def gate(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row per limit: the metric's value, the limit and whether it holds; a missing metric fails."""
    held = [n for n in limits if n in metrics.columns]
    pairs = ", ".join(f"'{n}', cast({n if n in held else 'NULL'} AS double), cast({limit} AS double)" for n, limit in limits.items())
    rows = metrics.select(F.expr(f"stack({len(limits)}, {pairs}) AS (metric, value, threshold)"))
    return rows.withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The element at floor(n * share) of the sorted values of each key, from counts per distinct value, summed by ranges of it."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = prefix_sum(counts, keys, value, [value], "_c", "_below").join(totals, keys)
    at = lambda s: F.least(F.floor(F.col("_n") * s), F.col("_n") - 1)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_below") > at(s), F.col(value))).alias(name) for name, s in shares.items()], F.sum("_c").alias("n"))


def with_composite(grades: DataFrame) -> DataFrame:
    """Adds final and composite to grades of factual, complete (0 to 3), entailment (0 to 1), calibrated and hard_fail.

    A hard failure makes both 0; an entailment under a half caps the final score at 2.
    """
    final = F.when(F.col("hard_fail"), 0).when(F.col("entailment") < 0.5, F.least(F.lit(2).cast("bigint"), "factual")).otherwise(F.col("factual"))
    score = F.col("final") * 0.4 + F.col("complete") * 0.3 + F.col("entailment") * 3 * 0.2 + F.when(F.col("calibrated"), 3).otherwise(0) * 0.1
    return grades.withColumn("final", final.cast("bigint")).withColumn("composite", F.when(F.col("final") == 0, 0.0).otherwise(score))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
