"""Wage rows made from parts, requests made from customers: thresholds, canonical rows, keys, lookups and extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import wages as W
from ..operators import windows
from ..sources.tables import table
from .registry import Registry

registry = Registry()
DATES = ("2022-01-01", "2023-02-01", "2024-03-01")

STEP_SQL = "CASE p_partkey % 7 WHEN 0 THEN 'Start' WHEN 1 THEN 'First ' || p_size || ' hours worked' WHEN 2 THEN 'Next ' || (p_size * 10) || ' Hours Worked' WHEN 3 THEN 'After ' || (p_size * 50) || ' hours' WHEN 4 THEN 'After ' || p_size || ' Months' WHEN 5 THEN 'Thereafter' ELSE 'Bonus' END"


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    step = (
        F.when(F.col("p_partkey") % 7 == 0, "Start").when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("First "), size.cast("string"), F.lit(" hours worked")))
        .when(F.col("p_partkey") % 7 == 2, F.concat(F.lit("Next "), (size * 10).cast("string"), F.lit(" Hours Worked"))).when(F.col("p_partkey") % 7 == 3, F.concat(F.lit("After "), (size * 50).cast("string"), F.lit(" hours")))
        .when(F.col("p_partkey") % 7 == 4, F.concat(F.lit("After "), size.cast("string"), F.lit(" Months"))).when(F.col("p_partkey") % 7 == 5, "Thereafter").otherwise("Bonus")
    )
    return table(spark, sf, "part").select("p_brand", "p_partkey", step.alias("step"))


@registry.query(f"""WITH RECURSIVE s AS (SELECT p_brand, p_partkey, {STEP_SQL} AS step, p_partkey % 7 AS k, p_size AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
r AS (SELECT p_brand, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS p_partkey, CAST(NULL AS VARCHAR) AS step, CAST(NULL AS BIGINT) AS hours, CAST(NULL AS BIGINT) AS months, CAST(NULL AS BIGINT) AS g FROM (SELECT DISTINCT p_brand FROM s)
UNION ALL SELECT s.p_brand, s.i, s.p_partkey, s.step, CASE s.k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN coalesce(g, 0) WHEN 3 THEN z * 50 WHEN 5 THEN g END, CASE s.k WHEN 0 THEN 0 WHEN 4 THEN z END,
CASE s.k WHEN 0 THEN 0 WHEN 1 THEN z WHEN 2 THEN coalesce(g, 0) + z * 10 WHEN 3 THEN greatest(coalesce(g, 0), z * 50) ELSE g END FROM r JOIN s ON s.p_brand = r.p_brand AND s.i = r.i + 1)
SELECT p_brand, p_partkey, step, hours, months FROM r WHERE i > 0""")
def step_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return W.step_thresholds(_steps(spark, sf), "p_brand", "p_partkey", "step")


@registry.query("""WITH g AS (SELECT p_brand, p_size, list({'k': p_partkey, 'rate': p_retailprice % 7, 'c': (p_partkey % 10) / 10.0::DOUBLE, 'n': 0} ORDER BY p_partkey) AS l FROM part GROUP BY ALL),
m AS (SELECT p_brand, p_size, len(l) AS seen, list_reduce(l, lambda a, b: CASE WHEN abs(a.rate - b.rate) >= 1e-9 AND b.c > a.c + 0.05::DOUBLE THEN {'k': b.k, 'rate': b.rate, 'c': b.c, 'n': a.n + 1} ELSE a END) AS r FROM g)
SELECT p_brand, p_size, r.rate AS rate, r.c AS confidence, CAST(r.n AS BIGINT) AS conflicts, seen FROM m""")
def canonical_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", (F.col("p_retailprice") % 7).alias("r"), ((F.col("p_partkey") % 10) / 10.0).alias("c"))
    return W.canonical_rows(p, ["p_brand", "p_size"], ["p_partkey"], "r", "c")


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    date = F.element_at(F.array(*[F.lit(d) for d in DATES]), (size % 3 + 1).cast("int"))
    kind = F.when(k % 25 % 3 == 0, F.when(k % 4 == 0, "fixed").otherwise("hours")).when(k % 25 % 3 == 1, F.when(k % 4 == 0, "fixed").otherwise("months")).otherwise("fixed")
    return table(spark, sf, "part").select(
        F.concat(F.lit("brand_"), (k % 25).cast("string")).alias("class_key"), date.alias("effective_date"), kind.alias("step_type"), F.when(kind == "hours", size * 100).when(kind == "months", size).cast("int").alias("threshold"),
        F.round(F.col("p_retailprice") / 50, 2).alias("rate"), ((k % 10) / 10.0).alias("confidence"), F.when(k % 2 == 0, F.concat(F.lit("t"), (k % 5).cast("string"))).alias("table_id"), (k % 9).alias("row_index"), F.col("p_name").alias("step_name"),
    )


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    on = F.element_at(F.array(F.lit("2021-05-05"), F.lit("2022-06-01"), F.lit("2023-02-01"), F.lit("2030-01-01")), (k % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("brand_"), (k % 30).cast("string")).alias("class_key"), F.when(k % 5 != 0, on).alias("on"), (k * 13 % 5000).alias("hours"), (k % 60).alias("months"))


@registry.query("""WITH r AS (SELECT 'brand_' || (p_partkey % 25) AS class_key, ['2022-01-01', '2023-02-01', '2024-03-01'][p_size % 3 + 1] AS d, CASE p_partkey % 25 % 3 WHEN 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'fixed' ELSE 'hours' END WHEN 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 'fixed' ELSE 'months' END ELSE 'fixed' END AS kind,
p_size, round(p_retailprice / 50, 2) AS rate, (p_partkey % 10) / 10.0::DOUBLE AS conf, CASE WHEN p_partkey % 2 = 0 THEN 't' || (p_partkey % 5) END AS table_id, p_partkey % 9 AS row_index, p_name AS step FROM part),
t AS (SELECT *, CASE kind WHEN 'hours' THEN p_size * 100 WHEN 'months' THEN p_size END AS threshold FROM r),
a AS (SELECT c_custkey, 'brand_' || (c_custkey % 30) AS class_key, CASE WHEN c_custkey % 5 <> 0 THEN ['2021-05-05', '2022-06-01', '2023-02-01', '2030-01-01'][c_custkey % 4 + 1] END AS "on", c_custkey * 13 % 5000 AS hours, c_custkey % 60 AS months FROM customer),
d AS (SELECT a.*, coalesce((SELECT max(d) FROM t WHERE t.class_key = a.class_key AND d <= "on"), (SELECT max(d) FROM t WHERE t.class_key = a.class_key)) AS d FROM a),
k AS (SELECT class_key, d, CASE WHEN bool_or(kind = 'hours') THEN 'hours' WHEN bool_or(kind = 'months') THEN 'months' ELSE 'fixed' END AS prog FROM t GROUP BY ALL),
j AS (SELECT d.*, t.kind, t.threshold, t.rate, t.conf, t.table_id, t.row_index, t.step, prog, (prog = 'fixed' OR t.kind = 'fixed' OR (t.kind = prog AND CASE WHEN prog = 'hours' THEN hours ELSE months END >= coalesce(threshold, 0))) AS fit FROM d JOIN t ON t.class_key = d.class_key AND t.d = d.d JOIN k ON k.class_key = d.class_key AND k.d = d.d),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY fit DESC, CASE WHEN kind = prog THEN 0 WHEN kind = 'fixed' THEN 1 ELSE 2 END, -coalesce(threshold, 0), -conf, table_id IS NULL, step, rate) AS r FROM j), c AS (SELECT * FROM b WHERE r = 1),
e AS (SELECT c.c_custkey, count(DISTINCT (j.table_id, j.row_index)) AS evidence FROM c JOIN j ON j.c_custkey = c.c_custkey AND j.step = c.step AND abs(j.rate - c.rate) <= 1e-9 GROUP BY 1)
SELECT d.c_custkey, d.class_key, d."on", d.hours, d.months, d.d AS effective_date, c.step, c.rate, evidence FROM d LEFT JOIN c ON c.c_custkey = d.c_custkey LEFT JOIN e ON e.c_custkey = d.c_custkey""")
def wage_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return W.wage_lookup(_asked(spark, sf), _rates(spark, sf))


ALIASES = (("smith_shop", "small"), ("lg", "large"), ("none", "absent"))


@registry.query("""WITH k(class_key) AS (VALUES ('economy'), ('large'), ('medium_size'), ('small')), al(alias, class_key) AS (VALUES ('smith_shop', 'small'), ('lg', 'large'), ('none', 'absent')),
a AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_type WHEN 1 THEN ' Smith  Shop ' WHEN 2 THEN 'LG' WHEN 3 THEN 'none' WHEN 4 THEN 'medium' WHEN 5 THEN 'Very Large-Scale' ELSE '??' END AS asked FROM part),
n AS (SELECT p_partkey, asked, regexp_replace(regexp_replace(lower(trim(asked)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM a)
SELECT p_partkey, asked, coalesce((SELECT k.class_key FROM al JOIN k USING (class_key) WHERE alias = n), (SELECT class_key FROM k WHERE class_key = n), (SELECT min(class_key) FROM k WHERE n <> '' AND (contains(class_key, n) OR contains(n, class_key)))) AS class_key FROM n""")
def classification_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    asked = F.when(k == 0, F.col("p_type")).when(k == 1, " Smith  Shop ").when(k == 2, "LG").when(k == 3, "none").when(k == 4, "medium").when(k == 5, "Very Large-Scale").otherwise("??")
    classes = spark.createDataFrame([("economy",), ("large",), ("medium_size",), ("small",)], "class_key string")
    return W.classification_key(table(spark, sf, "part").select("p_partkey", asked.alias("asked")), "asked", classes, spark.createDataFrame(ALIASES, "alias string, class_key string"))


RATES_TEXT = "p_name || ': $' || p_size || '.' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') || ' effective ' || (p_partkey % 12 + 1) || '/' || (p_partkey % 28 + 1) || '/20' || (p_partkey % 20 + 10) || ', ' || (p_size % 6 + 1) || ' weeks after ' || (p_size % 9 + 1) || ' years'"


@registry.query(f"""WITH t AS (SELECT p_partkey, {RATES_TEXT} AS t FROM part) SELECT p_partkey, CAST(regexp_extract(t, '\\$\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS rate, strftime(make_date(CAST(regexp_extract(t, '(\\d+)/(\\d+)/(\\d{{4}})', 3) AS INT), CAST(regexp_extract(t, '(\\d+)/(\\d+)/(\\d{{4}})', 1) AS INT), CAST(regexp_extract(t, '(\\d+)/(\\d+)/(\\d{{4}})', 2) AS INT)), '%Y-%m-%d') AS day,
CAST(regexp_extract(t, '(\\d+) weeks? after (\\d+) years?', 1) AS INT) AS weeks, CAST(regexp_extract(t, '(\\d+) weeks? after (\\d+) years?', 2) AS INT) AS years FROM t""")
def rate_date_tier_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Amount, ISO date and entitlement tier of a line of a wage table."""
    t = table(spark, sf, "part").select("p_partkey", F.expr(RATES_TEXT).alias("t"))
    day, tier = r"(\d+)/(\d+)/(\d{4})", r"(\d+) weeks? after (\d+) years?"
    part = lambda p, i: F.regexp_extract("t", p, i).cast("int")
    return t.select("p_partkey", F.regexp_extract("t", r"\$\s*(\d+(?:\.\d+)?)", 1).cast("double").alias("rate"), F.date_format(F.make_date(part(day, 3), part(day, 1), part(day, 2)), "yyyy-MM-dd").alias("day"), part(tier, 1).alias("weeks"), part(tier, 2).alias("years"))


@registry.query("""WITH p AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM p)
SELECT p_partkey, slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM r""")
def unique_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """The first name keeps its slug, the others get -2, -3 and so on: ranges of each name's ids, so that a frequent name is no single task."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    p = table(spark, sf, "part").select("p_partkey", slug.alias("slug"))
    n = windows.ordinal(p, "slug", "p_partkey", "n")
    return n.select("p_partkey", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("slug"))


@registry.query("""WITH s(label, day) AS (VALUES ('first', '2024-01-01'), ('second', '2025-01-01'), ('third', '2026-01-01')), b AS (SELECT p_partkey, sha256(p_name) AS prev, [p_retailprice, CASE WHEN p_size % 2 = 0 THEN p_retailprice + 1 END, p_retailprice + 2] AS rates FROM part)
SELECT p_partkey, prev, label, day, CASE label WHEN 'first' THEN rates[1] WHEN 'second' THEN rates[2] ELSE rates[3] END AS rate FROM b, s WHERE CASE label WHEN 'first' THEN rates[1] WHEN 'second' THEN rates[2] ELSE rates[3] END IS NOT NULL""")
def schedule_expand(spark: SparkSession, sf: str) -> DataFrame:
    """One operation per dated schedule that has a rate; all of them expect the base row's hash."""
    r = F.col("p_retailprice")
    dated = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(d).alias("day"), v.alias("rate")) for n, d, v in (("first", "2024-01-01", r), ("second", "2025-01-01", F.when(F.col("p_size") % 2 == 0, r + 1)), ("third", "2026-01-01", r + 2))])
    b = table(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("prev"), F.explode(F.filter(dated, lambda s: s["rate"].isNotNull())).alias("s"))
    return b.select("p_partkey", "prev", "s.*")


@registry.query("""WITH s(id, before, after, least, specific) AS (VALUES ('a', '1994-12-31', NULL, NULL, 1), ('b', NULL, '1993-01-01', NULL, 1), ('c', '1996-12-31', '1995-01-01', 500, 3), ('d', NULL, NULL, 900, 1)),
c AS (SELECT o_custkey, CASE WHEN o_custkey % 4 <> 0 THEN strftime(min(o_orderdate), '%Y-%m-%d') END AS hired, o_custkey * 7 % 2000 AS hours FROM orders GROUP BY o_custkey),
j AS (SELECT c.*, s.*, (hired IS NULL OR ((before IS NULL OR hired <= before) AND (after IS NULL OR hired >= after))) AND NOT (hours > 0 AND least IS NOT NULL AND hours < least) AS fits FROM c, s), n AS (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY o_custkey) AS m FROM j),
k AS (SELECT * FROM n WHERE fits OR m = 0), g AS (SELECT o_custkey, any_value(hired) AS hired, count(*) AS considered, bool_or(before IS NOT NULL OR after IS NOT NULL) AS windows, max_by(id, specific * 1000 + ascii(id)) AS best FROM k GROUP BY 1)
SELECT o_custkey, considered, CASE WHEN considered = 1 OR hired IS NOT NULL OR NOT windows THEN best END AS schedule_id FROM g""")
def schedule_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """The schedule of a date of hire and of hours; without a date, windows of hire leave it open (null)."""
    s = spark.createDataFrame([("a", "1994-12-31", None, None, 1), ("b", None, "1993-01-01", None, 1), ("c", "1996-12-31", "1995-01-01", 500, 3), ("d", None, None, 900, 1)], "id string, before string, after string, least int, specific int")
    s = s.agg(F.collect_list(F.struct("specific", "id", "before", "after", "least")).alias("all"))
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d")).select("o_custkey", F.when(F.col("o_custkey") % 4 != 0, F.date_format("d", "yyyy-MM-dd")).alias("hired"), (F.col("o_custkey") * 7 % 2000).alias("hours"))
    inside = lambda x: F.col("hired").isNull() | ((x["before"].isNull() | (F.col("hired") <= x["before"])) & (x["after"].isNull() | (F.col("hired") >= x["after"])))
    enough = lambda x: ~((F.col("hours") > 0) & x["least"].isNotNull() & (F.col("hours") < F.coalesce(x["least"], F.lit(0))))
    fits = F.filter("all", lambda x: inside(x) & enough(x))
    told = c.crossJoin(F.broadcast(s)).withColumn("fits", fits).withColumn("fits", F.when(F.size("fits") > 0, F.col("fits")).otherwise(F.col("all")))
    open_ = F.col("hired").isNull() & F.exists("fits", lambda x: x["before"].isNotNull() | x["after"].isNotNull()) & (F.size("fits") > 1)
    return told.select("o_custkey", F.size("fits").cast("bigint").alias("considered"), F.when(~open_, F.array_max("fits")["id"]).alias("schedule_id"))


@registry.query("""WITH p AS (SELECT p_partkey, p_brand, p_size % 2 AS amended, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS page FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY amended DESC, page IS NOT NULL DESC, p_partkey) AS r FROM p) SELECT p_brand, p_partkey, page FROM r WHERE r = 1""")
def provenance_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The reference that tells most: of an amendment, with a page, the first."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") % 2).alias("amended"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("page"))
    return windows.top_per_key(p, ["p_brand"], [F.desc("amended"), F.col("page").isNotNull().desc(), F.col("p_partkey")]).select("p_brand", "p_partkey", "page")


@registry.query("""WITH p AS (SELECT p_brand, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN contains(p_name, 'steel') THEN 30 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 15 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 40 ELSE 0 END DESC, p_partkey) AS r,
CASE WHEN contains(p_name, 'steel') THEN 30 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 15 ELSE 0 END - CASE WHEN p_size % 5 = 0 THEN 40 ELSE 0 END AS score FROM part) SELECT p_brand, p_partkey AS page, score FROM p WHERE r = 1 AND score > 0""")
def best_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of the highest weighted score of words, with penalties for pages of lists, if it is above 0; the first on ties."""
    has = lambda w, n: F.when(F.col("p_name").contains(w), n).otherwise(0)
    score = has("steel", 30) + has("red", 15) - F.when(F.col("p_size") % 5 == 0, 40).otherwise(0)
    p = table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("page"), score.alias("score"))
    return windows.top_per_key(p, ["p_brand"], [F.desc("score"), F.col("page")]).filter("score > 0")
