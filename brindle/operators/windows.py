"""Per-key tops, ordered merges, neighbourhoods, dense series and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key; Spark cuts each partition's groups before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
    return ranked.drop(rank) if rank == "_rank" else ranked


def ordered_merge(lists: list[DataFrame], key: str, order: str, limit: int) -> DataFrame:
    """Lists one after another, each key once at its first place, ``limit`` rows at most; adds ``place``.

    The lists are themselves top-k results, so that the ranking in one partition is of bounded size.
    """
    union = None
    for i, one in enumerate(lists):
        part = one.select(key, F.lit(i).alias("_list"), F.col(order).alias("_order"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy(key).agg(F.min(F.struct("_list", "_order")).alias("_at"))
    merged = first.orderBy("_at", key).limit(limit)
    return merged.select(key, F.row_number().over(Window.orderBy("_at", key)).cast("bigint").alias("place"))


def neighbourhood(df: DataFrame, keys: list[str], order: str, hits: Column, before: int, after: int) -> DataFrame:
    """Rows from ``before`` places ahead of a hit to ``after`` places behind one, within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.max(hits.cast("int")).over(w.rowsBetween(-after, before))
    return df.withColumn("_near", near).filter("_near = 1").drop("_near")


def dense_days(df: DataFrame, day: Column, first: str, days: int, metrics: list[Column], zeros: dict[str, object]) -> DataFrame:
    """One row for each of ``days`` days from ``first`` on, with zeros where there is nothing."""
    spark = df.sparkSession
    calendar = spark.range(days).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    inside = df.withColumn("day", day).filter((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.date_add(F.lit(first).cast("date"), days)))
    return calendar.join(inside.groupBy("day").agg(*metrics), "day", "left").fillna(zeros)


def sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Adds session: the number of the run of rows of a key with gaps of ``gap_seconds`` at most."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    far = (seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000).cast("int")
    return df.withColumn("session", (F.sum(F.coalesce(far, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("bigint"))


def running_total(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def in_ranges(df: DataFrame, by: str, name: str, parts: int = 64) -> DataFrame:
    """Adds the number of the range of a numeric column that a row lies in; ranges hold about as many rows each."""
    bounds = sorted(set(df.approxQuantile(by, [i / parts for i in range(1, parts)], 0.005)))
    return df.withColumn(name, F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(by))) if bounds else F.lit(0))


def prefix_sum(df: DataFrame, keys: list[str], by: str, order: list, value: str, name: str, parts: int = 64) -> DataFrame:
    """Adds the running sum of a value within each key, where ``by`` is a number that never falls along the order.

    A key's rows spread over ranges of the number: sums within a range, and of the ranges before it.
    """
    ranged = in_ranges(df, by, "_part", parts)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_s")).drop("_s")
    local = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_here", local).join(before, [*keys, "_part"]).withColumn(name, F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def ordinal(df: DataFrame, key: str, order: str, name: str, parts: int = 64) -> DataFrame:
    """Adds each row's number within its key, by a unique number; a key that holds most rows spreads over ranges of it."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), [key], order, [order], "_one", name, parts).drop("_one")
