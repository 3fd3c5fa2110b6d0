"""Deterministic table lookups: as-of, threshold, tier, schedule, progression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lookup, windows
from ..sources.tables import table
from .registry import Registry

registry = Registry()
STEPS = [(0, "start"), (10, "ten"), (20, "twenty"), (35, "top")]
TIERS = [(1, 1), (2, 2), (5, 3), (12, 4), (20, 5)]
NOW = "2024-01-31"


def _first_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("hired"))


FIRST = "f AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS hired FROM orders GROUP BY o_custkey), m AS (SELECT *, greatest(0, (year(DATE '2024-01-31') * 12 + month(DATE '2024-01-31')) - (year(hired) * 12 + month(hired))) AS months FROM f)"


@registry.query("""SELECT o_custkey, early, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, o_orderdate <= TIMESTAMP '1995-06-01' AS early,
row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderdate <= TIMESTAMP '1995-06-01') DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return lookup.latest_as_of(o, ["o_custkey"], "o_orderdate", F.lit("1995-06-01").cast(o.schema["o_orderdate"].dataType), ["o_totalprice"], "o_orderkey")


@registry.query(f"""WITH s(threshold, step) AS (VALUES {", ".join(f"({a}, '{b}')" for a, b in STEPS)})
SELECT p_partkey, p_size, threshold, step FROM (SELECT p_partkey, p_size, threshold, step, row_number() OVER (PARTITION BY p_partkey ORDER BY threshold DESC) AS r FROM part LEFT JOIN s ON p_size >= threshold) WHERE r = 1""")
def threshold_step(spark: SparkSession, sf: str) -> DataFrame:
    steps = spark.createDataFrame(STEPS, "threshold int, step string")
    return lookup.threshold_step(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", steps, "threshold", ["step"])


@registry.query(f"""WITH {FIRST}, t(years, weeks) AS (VALUES {", ".join(map(str, TIERS))})
SELECT o_custkey, CAST(months AS BIGINT) AS months, CASE WHEN months > 0 THEN (SELECT max(weeks) FROM t WHERE m.months // 12 >= years) END AS weeks FROM m""")
def tier_entitlement(spark: SparkSession, sf: str) -> DataFrame:
    months = lookup.months_between_calendars(F.col("hired"), F.lit(NOW).cast("date"))
    tiers = F.array(*[F.struct(F.lit(y).alias("years"), F.lit(w).alias("weeks")) for y, w in TIERS])
    reached = F.array_max(F.transform(F.filter(tiers, lambda t: F.expr("months div 12") >= t["years"]), lambda t: t["weeks"]))
    return _first_orders(spark, sf).select("o_custkey", months.alias("months")).withColumn("weeks", F.when(F.col("months") > 0, reached))


@registry.query(f"""WITH {FIRST} SELECT o_custkey, CAST(months AS BIGINT) AS months, CAST(trunc(months * 4.33::DOUBLE * CASE WHEN o_custkey % 2 = 0 THEN 36 ELSE 20 END) AS BIGINT) AS hours,
hired < DATE '2005-03-27' AS grandfathered FROM m""")
def months_and_hours_estimate(spark: SparkSession, sf: str) -> DataFrame:
    months = lookup.months_between_calendars(F.col("hired"), F.lit(NOW).cast("date"))
    weekly = F.when(F.col("o_custkey") % 2 == 0, 36).otherwise(20)
    return _first_orders(spark, sf).select("o_custkey", months.alias("months"), lookup.estimated_hours(months, weekly).alias("hours"), (F.col("hired") < F.lit("2005-03-27").cast("date")).alias("grandfathered"))


@registry.query(f"""WITH {FIRST}, s(schedule_id, before, after, specific) AS (VALUES ('a', DATE '1994-12-31', NULL, 1), ('b', NULL, DATE '1993-01-01', 1), ('c', DATE '1996-12-31', DATE '1995-01-01', 2), ('d', NULL, NULL, 0)),
r AS (SELECT o_custkey, schedule_id, row_number() OVER (PARTITION BY o_custkey ORDER BY specific DESC, schedule_id DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n
FROM m JOIN s ON (before IS NULL OR hired <= before) AND (after IS NULL OR hired >= after)) SELECT o_custkey, schedule_id, n AS considered FROM r WHERE r = 1""")
def schedule_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The most specific schedule whose open or closed window holds the date; the schedules are a small broadcast table."""
    s = spark.createDataFrame([("a", "1994-12-31", None, 1), ("b", None, "1993-01-01", 1), ("c", "1996-12-31", "1995-01-01", 2), ("d", None, None, 0)], "schedule_id string, before string, after string, specific int")
    s = s.agg(F.collect_list(F.struct("specific", "schedule_id", F.col("before").cast("date").alias("before"), F.col("after").cast("date").alias("after"))).alias("all"))
    fits = F.filter("all", lambda x: (x["before"].isNull() | (F.col("hired") <= x["before"])) & (x["after"].isNull() | (F.col("hired") >= x["after"])))
    joined = _first_orders(spark, sf).crossJoin(F.broadcast(s)).withColumn("fits", fits).filter(F.size("fits") > 0)
    return joined.select("o_custkey", F.array_max("fits")["schedule_id"].alias("schedule_id"), F.size("fits").cast("bigint").alias("considered"))


@registry.query("SELECT p_brand, p_size, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS next_size FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def progression_next_step(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    return steps.withColumn("next_size", F.lead("p_size").over(Window.partitionBy("p_brand").orderBy("p_size")))


@registry.query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r,
lead(n) OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS second FROM c) SELECT p_brand, p_type, n, n - second AS margin FROM r WHERE r = 1""")
def default_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """One default per key by rank, and its margin over the second best."""
    c = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type")
    margin = c.withColumn("margin", F.col("n") - F.lead("n").over(w))
    return windows.top_per_key(margin, ["p_brand"], [F.desc("n"), F.col("p_type")])


@registry.query("""SELECT l_orderkey, l_linenumber, l_quantity, CAST(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS reached FROM lineitem""")
def accumulated_steps(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return windows.running_total(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", "reached").select("l_orderkey", "l_linenumber", "l_quantity", "reached")
