"""Deterministic lookups: as of a date, by threshold, by tier and by schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_as_of(df: DataFrame, keys: list[str], date: str, as_of: Column, values: list[str], tie: str) -> DataFrame:
    """Per key the row of the latest date up to ``as_of``, or of the latest of all where none is that early.

    One aggregation with partial results: the largest of (is early enough, date, tie).
    """
    early = F.col(date) <= as_of
    row = F.struct(early.alias("early"), F.col(date), F.col(tie), *[F.col(v) for v in values if v not in (date, tie)])
    best = df.groupBy(*keys).agg(F.max(row).alias("_best"))
    return best.select(*keys, "_best.*")


def threshold_step(df: DataFrame, value: str, steps: DataFrame, threshold: str, step_columns: list[str]) -> DataFrame:
    """The step of the largest threshold that ``value`` reaches; null where it reaches none. ``steps`` is a small table, read once.

    The steps become one sorted array, so that the rows are neither multiplied nor shuffled.
    """
    rows = steps.agg(F.sort_array(F.collect_list(F.struct(threshold, *step_columns)), asc=False).alias("_steps"))
    reached = F.get(F.filter("_steps", lambda s: s[threshold] <= F.col(value)), F.lit(0))
    found = df.crossJoin(F.broadcast(rows)).withColumn("_step", reached)
    return found.select(*df.columns, F.col(f"_step.{threshold}").alias(threshold), *[F.col(f"_step.{c}").alias(c) for c in step_columns])


def months_between_calendars(start: Column, end: Column) -> Column:
    """Months by calendar, whatever the day; never below 0."""
    return F.greatest(F.lit(0), (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))).cast("bigint")


def estimated_hours(months: Column, weekly: Column) -> Column:
    return (months * F.lit(4.33) * weekly).cast("bigint")
