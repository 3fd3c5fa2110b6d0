"""Wage tables: step thresholds, canonical rows, classification keys and the lookup of a rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_thresholds(rows: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """Adds hours and months that a step asks for, by running sums along the ordered steps of a class.

    start: 0 and 0; after N hours or months: N; first N hours worked: 0, and N are gathered; next N: what is gathered, and
    N more; thereafter: what is gathered.

    A start or a first step sets what is gathered, a next one adds to it and one after N raises it to N. So behind a setting it is the
    sum of what was added since, and the largest of what was set or raised to, less the sum at that place.
    """
    low = F.lower(F.trim(step))
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("bigint")
    kinds = [("after_hours", number(r"after\s+(\d+)\s+hours?")), ("after_months", number(r"after\s+(\d+)\s+months?")), ("first", number(r"first\s+(\d+)\s+hours?\s+worked")), ("next", number(r"next\s+(\d+)\s+hours?\s+worked"))]
    kind = F.when(low == "start", "start")
    for name, n in kinds:
        kind = kind.when(n.isNotNull(), name)
    kind = kind.when(low.startswith("thereafter"), "thereafter").otherwise("none")
    told = rows.withColumn("_k", kind).withColumn("_v", F.coalesce(*[n for _, n in kinds]))
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(order, step, "_k", "_v").rowsBetween(Window.unboundedPreceding, 0)
    k, zero = F.col("_k"), F.lit(0).cast("bigint")
    told = told.withColumn("_set", F.count(F.when(k.isin("start", "first"), 1)).over(so_far(key))).withColumn("_known", F.count(F.when(k.isin("start", "first", "next", "after_hours"), 1)).over(so_far(key)) > 0)
    told = told.withColumn("_added", F.coalesce(F.sum(F.when(k == "next", F.col("_v"))).over(so_far(key, "_set")), zero))
    level = F.when(k == "start", 0).when(k == "first", F.col("_v")).when(k == "after_hours", F.col("_v") - F.col("_added"))
    level = F.max(level).over(so_far(key, "_set"))
    # Ahead of the first setting nothing is gathered, which counts as 0.
    held = F.col("_added") + F.when(F.col("_set") == 0, F.greatest(level, zero)).otherwise(level)
    hours = F.when(k.isin("start", "first"), zero).when(k == "after_hours", F.col("_v")).when(k == "next", held - F.col("_v")).when((k == "thereafter") & F.col("_known"), held)
    months = F.when(k == "start", zero).when(k == "after_months", F.col("_v"))
    return told.select(key, order, step, hours.alias("hours"), months.alias("months"))


def canonical_rows(rows: DataFrame, keys: list[str], order: list[str], rate: str, confidence: str, least: float = 0.05) -> DataFrame:
    """One row per key: the first, unless a later one has another rate and a confidence higher by more than ``least``.

    ``seen`` counts the key's rows, ``conflicts`` those that took the place of another. A key's rows are few sources.
    """
    each = F.struct(*order, F.col(rate).alias("rate"), F.col(confidence).alias("confidence"))
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("_all"))
    keep = lambda r, n: F.struct(r["rate"].alias("rate"), r["confidence"].alias("confidence"), n.alias("conflicts"))

    def merge(a: Column, b: Column) -> Column:
        replaced = (F.abs(a["rate"] - b["rate"]) >= 1e-9) & (b["confidence"] > a["confidence"] + least)
        return F.when(replaced, keep(b, a["conflicts"] + 1)).otherwise(a)

    chosen = F.aggregate(F.slice("_all", 2, F.size("_all")), keep(F.col("_all")[0], F.lit(0)), merge)
    return held.select(*keys, chosen.alias("c"), F.size("_all").cast("bigint").alias("seen")).select(*keys, "c.rate", "c.confidence", F.col("c.conflicts").cast("bigint").alias("conflicts"), "seen")


def normalized_name(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def classification_key(asked: DataFrame, name: str, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds class_key: the class itself, else its alias, else the first class that contains it or is contained.

    ``classes`` (class_key) and ``aliases`` (alias, class_key) are small dimension tables: an array per row of one.
    """
    known = classes.agg(F.array_sort(F.collect_set("class_key")).alias("_classes"))
    told = asked.withColumn("_n", normalized_name(F.col(name))).crossJoin(F.broadcast(known)).join(F.broadcast(aliases.select(F.col("alias").alias("_n"), F.col("class_key").alias("_alias"))), "_n", "left")
    inside = F.filter("_classes", lambda c: (F.col("_n") != "") & (c.contains(F.col("_n")) | F.col("_n").contains(c)))
    key = F.when(F.array_contains("_classes", F.col("_alias")), F.col("_alias")).when(F.array_contains("_classes", F.col("_n")), F.col("_n")).otherwise(F.get(inside, F.lit(0)))
    return told.withColumn("class_key", key).drop("_n", "_classes", "_alias")


def rate_steps(rates: DataFrame) -> DataFrame:
    """Per class and date: the kind of its progression, the best row of each threshold of that kind, the best fixed one, the best of all.

    A row is better by its kind, a higher threshold, a higher confidence, a table, its step's name and its rate. ``evidence``
    counts the places in tables that give a row's step and rate. What is gathered are distinct thresholds, not rows.
    """
    keys = ["class_key", "effective_date"]
    first = lambda kind: F.max(F.col("step_type") == kind)
    kinds = rates.groupBy(*keys).agg(F.when(first("hours"), "hours").when(first("months"), "months").otherwise("fixed").alias("kind"))
    same = [*keys, "step", "_rate"]
    told = rates.withColumn("step", F.coalesce("step_name", F.lit(""))).withColumn("_rate", F.round("rate", 8))
    places = told.groupBy(*same).agg(F.count_distinct(F.struct("table_id", "row_index")).alias("evidence"))
    told = told.join(kinds, keys).join(places, same)
    rank = F.struct(
        F.when(F.col("step_type") == F.col("kind"), 0).when(F.col("step_type") == "fixed", 1).otherwise(2).alias("a"), (-F.coalesce("threshold", F.lit(0))).alias("b"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"),
        F.when(F.col("table_id").isNotNull(), 0).otherwise(1).alias("d"), "step", "rate", "evidence",
    )
    per = told.groupBy(*keys, "kind", "step_type", F.coalesce("threshold", F.lit(0)).alias("threshold")).agg(F.min(rank).alias("best"))
    return per.groupBy(*keys, "kind").agg(
        F.collect_list(F.when(F.col("step_type") == F.col("kind"), F.struct("threshold", "best"))).alias("steps"),
        F.min(F.when(F.col("step_type") == "fixed", F.col("best"))).alias("fixed"), F.min("best").alias("any"),
    )


def wage_lookup(asked: DataFrame, rates: DataFrame) -> DataFrame:
    """The rate of each request (class_key, on, hours, months) from rates (class_key, effective_date, step_type, threshold, rate, confidence, table_id, row_index, step_name).

    The date is the latest one not after the request's, else the last; hours decide where the date has steps of hours, else
    months. The step is that of the highest threshold that is reached, else a fixed one, else the best of all. A class's
    dates and a date's thresholds are looked through; how many rows they come from doesn't matter.
    """
    steps = rate_steps(rates)
    dates = steps.groupBy("class_key").agg(F.collect_list("effective_date").alias("_dates"))
    a = asked.join(dates, "class_key", "left")
    a = a.withColumn("effective_date", F.coalesce(F.array_max(F.filter("_dates", lambda d: d <= F.col("on"))), F.array_max("_dates"))).join(steps, ["class_key", "effective_date"], "left")
    served = F.when(F.col("kind") == "hours", F.col("hours")).otherwise(F.col("months"))
    reached = F.array_max(F.filter("steps", lambda s: (F.col("kind") != "fixed") & (served >= s["threshold"])))["best"]
    a = a.withColumn("_best", F.when(F.col("kind") == "fixed", F.col("any")).otherwise(F.coalesce(reached, "fixed", "any")))
    return a.select(*asked.columns, "effective_date", F.col("_best.step").alias("step"), F.col("_best.rate").alias("rate"), F.col("_best.evidence").alias("evidence"))
