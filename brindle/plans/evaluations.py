"""Versions, reconciliation and evaluation metrics over part, labels, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, versions
from ..sources.tables import table
from .registry import Registry

registry = Registry()


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size")


def _patch(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh part gets a new size; every 21st patch expects a hash that no row has."""
    p = _part(spark, sf).filter("p_partkey % 7 = 0")
    right = versions.row_hash(F.col("p_name"), F.col("p_size"))
    return p.select("p_partkey", (F.col("p_size") + 100).alias("new_size"), F.when(F.col("p_partkey") % 21 == 0, F.lit("stale")).otherwise(right).alias("expected"))


@registry.query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 21 <> 0 THEN p_size + 100 ELSE p_size END AS p_size,
CASE WHEN p_partkey % 7 <> 0 THEN 'unchanged' WHEN p_partkey % 21 = 0 THEN 'hash_mismatch' ELSE 'replaced' END AS status FROM part""")
def replace_row_hash_guard(spark: SparkSession, sf: str) -> DataFrame:
    return versions.replace_guarded(_part(spark, sf), _patch(spark, sf), "p_partkey", "p_size", "new_size", "expected", versions.row_hash(F.col("p_name"), F.col("p_size")))


@registry.query("""SELECT p_partkey, '2022-01-01' AS effective, p_size FROM part WHERE NOT (p_partkey % 10 = 0) UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '2022-01-01' ELSE '2023-01-01' END, p_size + 1 FROM part WHERE p_partkey % 5 = 0""")
def supersede_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = _part(spark, sf).select("p_partkey", F.lit("2022-01-01").alias("effective"), "p_size")
    newer = _part(spark, sf).filter("p_partkey % 5 = 0").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "2022-01-01").otherwise("2023-01-01").alias("effective"), (F.col("p_size") + 1).alias("p_size"))
    return versions.supersede(base, newer, "p_partkey", "effective")


@registry.query("""WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'extra' WHEN a.p_size IS NOT DISTINCT FROM b.p_size THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def reconcile_versions(spark: SparkSession, sf: str) -> DataFrame:
    p = _part(spark, sf)
    later = p.filter("p_partkey % 11 != 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return versions.reconcile(p.filter("p_partkey % 9 != 0"), later, "p_partkey", "p_size")


@registry.query("SELECT p_brand, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS content_hash FROM (SELECT p_brand, sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, CAST(p_size AS VARCHAR))) AS h FROM part) GROUP BY p_brand")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One hash per set of artifacts: a set is the rows of one contract, some thousands at most, whose hashes are gathered."""
    h = table(spark, sf, "part").select("p_brand", versions.row_hash(F.col("p_partkey"), F.col("p_name"), F.col("p_size")).alias("h"))
    return h.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("content_hash"))


@registry.query("""SELECT p_partkey, CASE WHEN r = 1 THEN p_type ELSE p_type || '__dup' || CAST(r - 1 AS VARCHAR) END AS chunk_id FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part)""")
def dup_id_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return versions.duplicate_suffix(table(spark, sf, "part"), "p_type", ["p_partkey"], "chunk_id").select("p_partkey", "chunk_id")


@registry.query("""WITH j AS (SELECT quality = 1 AS t, d.n_chars >= 500 AS p FROM labels JOIN documents d USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM j)
SELECT tp, fp, fn, tn, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 6) AS fpr FROM c""")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").filter("quality IS NOT NULL")
    return j.agg(*metrics.confusion(F.col("quality") == 1, F.col("n_chars") >= 500))


@registry.query("SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, bool_and(quality = 1) AS all_pass FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def pass_rate_by_group(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    ok = F.col("quality") == 1
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.bool_and(ok).alias("all_pass"))


@registry.query("SELECT source, count(*) AS variants, bool_and(quality = 1) AS family_pass, bool_or(toxic = 1) AS any_toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def family_all_pass(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("variants"), F.bool_and(F.col("quality") == 1).alias("family_pass"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"))


@registry.query("""WITH s AS (SELECT CASE WHEN value IS NULL THEN NULL ELSE least(3, CAST(floor(value / 50) AS INT)) END AS score FROM events) SELECT score, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE), 6) AS share FROM s GROUP BY score""")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").select(F.when(F.col("value").isNotNull(), F.least(F.lit(3), F.floor(F.col("value") / 50))).cast("int").alias("score"))
    g = s.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@registry.query("""WITH m AS (SELECT avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS quality_rate, avg(CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END) AS clean_rate FROM labels)
SELECT 'quality_rate' AS metric, round(quality_rate, 6) AS value, CAST(0.5 AS DOUBLE) AS threshold, coalesce(quality_rate >= 0.5, false) AS passed FROM m UNION ALL SELECT 'clean_rate', round(clean_rate, 6), 0.95, coalesce(clean_rate >= 0.95, false) FROM m UNION ALL SELECT 'coverage', NULL, 0.9, false FROM m""")
def gate_table(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "labels").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("quality_rate"), F.avg(F.when(F.col("toxic") == 1, 0.0).otherwise(1.0)).alias("clean_rate"))
    return metrics.gate(m, {"quality_rate": 0.5, "clean_rate": 0.95, "coverage": 0.9}).withColumn("value", F.round("value", 6))


@registry.query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(value) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99, max(n) AS n FROM s GROUP BY event_type""")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@registry.query("SELECT a.r_name AS contract, b.r_name AS other, n_name AS foreign_name FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey JOIN nation ON n_regionkey = b.r_regionkey")
def contamination_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered pairs of contracts beside the names that one must not see of the other; regions are a handful of rows."""
    r = table(spark, sf, "region")
    a, b = r.select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("contract")), r.select(F.col("r_regionkey").alias("b"), F.col("r_name").alias("other"))
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("b"), F.col("n_name").alias("foreign_name"))
    return b.join(n, "b").join(a, F.col("a") != F.col("b")).select("contract", "other", "foreign_name")


@registry.query("""WITH g AS (SELECT lang, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS base, avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END) AS variant FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round(base, 6) AS base, round(variant, 6) AS variant, round(variant - base, 6) AS delta FROM g""")
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    g = j.groupBy("lang").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("base"), F.avg(F.when(F.col("n_chars") >= 500, 1.0).otherwise(0.0)).alias("variant"))
    return g.select("lang", F.round("base", 6).alias("base"), F.round("variant", 6).alias("variant"), F.round(F.col("variant") - F.col("base"), 6).alias("delta"))


@registry.query("SELECT doc_id FROM documents ORDER BY sha256('17|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("17|"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@registry.query("""WITH t AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents) SELECT lang, count(*) AS docs, count(*) FILTER (copies > 1) AS copied FROM t GROUP BY lang""")
def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", F.md5("text").alias("h"))
    g = d.groupBy("h", "lang").agg(F.count(F.lit(1)).alias("n"))
    many = g.withColumn("copies", F.sum("n").over(Window.partitionBy("h")))
    return many.groupBy("lang").agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("copies") > 1, F.col("n")).otherwise(0)).alias("copied"))


@registry.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT l_orderkey, NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def reference_violations(spark: SparkSession, sf: str) -> DataFrame:
    o, c, li = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    lost = o.join(c, o.o_custkey == c.c_custkey, "left_anti").select("o_orderkey", "o_custkey")
    lines = li.join(o, li.l_orderkey == o.o_orderkey, "left_anti").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(None).cast("bigint").alias("o_custkey"))
    return lost.unionAll(lines)
