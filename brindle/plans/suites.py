"""Evaluation suites: needles, abstention, paraphrases, precedence, grading, entailment, ranks and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, windows
from ..sources.tables import table
from .registry import Registry

registry = Registry()


@registry.query("""WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size <> 7),
x AS (SELECT p_brand, 'chunk_' || p_partkey AS id, CASE WHEN i < n // 2 THEN 1 ELSE 3 END AS zone, i AS o FROM c UNION ALL SELECT p_brand, 'needle_' || p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 4 END, p_partkey + CASE WHEN p_partkey % 4 = 3 THEN 1000000000 ELSE 0 END FROM part WHERE p_size = 7)
SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY zone, o) AS place FROM x""")
def needle_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Each contract's chunks without old needles, and new ones on top, in the middle or at the bottom (where unknown ones go last)."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    w = Window.partitionBy("p_brand")
    c = p.filter("p_size != 7").withColumn("i", F.row_number().over(w.orderBy("p_partkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    chunks = c.select("p_brand", F.concat(F.lit("chunk_"), k.cast("string")).alias("id"), F.when(F.col("i") < F.expr("n div 2"), 1).otherwise(3).alias("zone"), F.col("i").cast("bigint").alias("o"))
    needles = p.filter("p_size = 7").select("p_brand", F.concat(F.lit("needle_"), k.cast("string")).alias("id"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 2).otherwise(4).alias("zone"), (k + F.when(k % 4 == 3, 1_000_000_000).otherwise(0)).alias("o"))
    return chunks.unionByName(needles).select("p_brand", "id", F.row_number().over(w.orderBy("zone", "o")).cast("bigint").alias("place"))


@registry.query("""WITH r AS (SELECT c_mktsegment AS scenario, c_nationkey % 5 AS contract, c_acctbal > 0 AS passed FROM customer) SELECT coalesce(scenario, 'all') AS scenario, coalesce(CAST(contract AS VARCHAR), 'all') AS contract, count(*) FILTER (passed) AS passed, count(*) AS total,
round(coalesce(count(*) FILTER (passed) / CAST(nullif(count(*), 0) AS DOUBLE), 0), 4) AS pass_rate FROM r GROUP BY GROUPING SETS ((scenario), (contract), ())""")
def abstention_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates per contract, per scenario and in all, from one pass."""
    r = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("scenario"), (F.col("c_nationkey") % 5).cast("string").alias("contract"), (F.col("c_acctbal") > 0).alias("passed"))
    g = r.groupingSets([["scenario"], ["contract"], []], "scenario", "contract").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    return g.select(F.coalesce("scenario", F.lit("all")).alias("scenario"), F.coalesce("contract", F.lit("all")).alias("contract"), "passed", "total", F.round(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), 4).alias("pass_rate"))


@registry.query("""WITH v AS (SELECT DISTINCT l_orderkey AS family, l_linenumber AS variant, l_partkey % 5 AS article FROM lineitem), n AS (SELECT family, count(DISTINCT variant) AS variants FROM v GROUP BY 1), a AS (SELECT family, article, count(DISTINCT variant) AS held FROM v GROUP BY ALL),
c AS (SELECT a.family, string_agg(CAST(article AS VARCHAR), ',' ORDER BY article) AS common FROM a JOIN n USING (family) WHERE held = variants GROUP BY 1), p AS (SELECT family, bool_and(ok) AS family_pass FROM (SELECT family, variant, bool_or(article IN (1, 2, 3)) AS ok FROM v GROUP BY ALL) GROUP BY 1)
SELECT n.family, variants, family_pass, coalesce(common, '') AS common FROM n JOIN p USING (family) LEFT JOIN c USING (family)""")
def paraphrase_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all variants of a question find an expected article, and the articles that all of them find."""
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("family"), F.col("l_linenumber").alias("variant"), (F.col("l_partkey") % 5).alias("article")).distinct()
    per = v.groupBy("family", "variant").agg(F.collect_set("article").alias("found"))
    ok = F.exists("found", lambda a: a.isin(1, 2, 3))
    g = per.groupBy("family").agg(F.count(F.lit(1)).alias("variants"), F.bool_and(ok).alias("family_pass"), F.collect_list("found").alias("sets"))
    common = F.aggregate(F.slice("sets", 2, F.size("sets")), F.col("sets")[0], lambda a, b: F.array_intersect(a, b))
    return g.select("family", "variants", "family_pass", F.array_join(F.array_sort(common), ",").alias("common"))


@registry.query("""WITH r AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank, l_partkey % 4 AS kind, l_suppkey % 29 = 0 AS foreign_, CAST(l_quantity AS INT) % 3 AS hits FROM lineitem), t AS (SELECT * FROM r WHERE rank <= 8),
g AS (SELECT q, min(rank) FILTER (kind = 1) AS expected, min(rank) FILTER (kind = 2) AS competing, max(hits) AS hits, bool_or(foreign_) AS leaked FROM t GROUP BY q)
SELECT q, expected, competing, expected IS NOT NULL AND hits >= 1 AND (competing IS NULL OR expected <= competing + 1) AND NOT leaked AS passed FROM g""")
def adversarial_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """First rank of what is expected and of what competes; passed with a hit, key words, a small gap and nothing foreign."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    top = windows.top_per_key(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 8, "rank")
    kind = F.col("l_partkey") % 4
    g = top.groupBy(F.col("l_orderkey").alias("q")).agg(
        F.min(F.when(kind == 1, F.col("rank"))).cast("bigint").alias("expected"), F.min(F.when(kind == 2, F.col("rank"))).cast("bigint").alias("competing"), F.max(F.col("l_quantity").cast("int") % 3).alias("hits"), F.bool_or(F.col("l_suppkey") % 29 == 0).alias("leaked"),
    )
    ok = F.col("expected").isNotNull() & (F.col("hits") >= 1) & (F.col("competing").isNull() | (F.col("expected") <= F.col("competing") + 1)) & ~F.col("leaked")
    return g.select("q", "expected", "competing", ok.alias("passed"))


GRADES = "g AS (SELECT o_orderkey, o_custkey % 4 AS factual, o_orderkey % 4 AS complete, (o_orderkey % 11) / 10.0::DOUBLE AS entailment, o_orderstatus = 'F' AS calibrated, o_custkey % 17 = 0 AS hard_fail, o_orderpriority FROM orders)"


def _grades(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    g = table(spark, sf, "orders").select("o_orderkey", (c % 4).alias("factual"), (k % 4).alias("complete"), ((k % 11) / 10.0).alias("entailment"), (F.col("o_orderstatus") == "F").alias("calibrated"), (c % 17 == 0).alias("hard_fail"), "o_orderpriority")
    return metrics.with_composite(g)


SCORED = f"{GRADES}, f AS (SELECT *, CASE WHEN hard_fail THEN 0 WHEN entailment < 0.5 THEN least(2, factual) ELSE factual END AS final FROM g), s AS (SELECT *, CASE WHEN final = 0 THEN 0.0::DOUBLE ELSE final * 0.4::DOUBLE + complete * 0.3::DOUBLE + entailment * 3 * 0.2::DOUBLE + CASE WHEN calibrated THEN 3 ELSE 0 END * 0.1::DOUBLE END AS composite FROM f)"


@registry.query(f"WITH {SCORED} SELECT o_orderkey, CAST(final AS BIGINT) AS final, round(composite, 4) AS composite FROM s")
def composite_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted score of the parts of a grade: zero on a hard failure, capped at 2 where too little is entailed."""
    return _grades(spark, sf).select("o_orderkey", "final", F.round("composite", 4).alias("composite"))


@registry.query(f"""WITH {SCORED} SELECT coalesce(o_orderpriority, 'overall') AS bucket, count(*) AS n, round(avg(composite), 2) AS mean, count(*) FILTER (final = 0) AS score_0, count(*) FILTER (final = 1) AS score_1, count(*) FILTER (final = 2) AS score_2, count(*) FILTER (final = 3) AS score_3,
count(*) FILTER (hard_fail) AS hard_fails, round(count(*) FILTER (hard_fail) / CAST(count(*) AS DOUBLE), 6) AS hard_fail_rate FROM s GROUP BY ROLLUP (o_orderpriority)""")
def evaluation_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, histogram and hard failures, per bucket and overall."""
    scores = [F.count_if(F.col("final") == i).alias(f"score_{i}") for i in range(4)]
    g = _grades(spark, sf).rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("composite"), 2).alias("mean"), *scores, F.count_if("hard_fail").alias("hard_fails"))
    return g.select(F.coalesce("o_orderpriority", F.lit("overall")).alias("bucket"), "n", "mean", *[f"score_{i}" for i in range(4)], "hard_fails", F.round(F.col("hard_fails") / F.col("n"), 6).alias("hard_fail_rate"))


@registry.query("""WITH v AS (SELECT l_orderkey, CASE l_partkey % 5 WHEN 0 THEN 'CONTRADICTS' WHEN 1 THEN 'IRRELEVANT' ELSE 'SUPPORTS' END AS verdict FROM lineitem WHERE l_tax > 0.03)
SELECT o_orderkey, count(verdict) AS claims, round(coalesce(count(*) FILTER (verdict = 'SUPPORTS') / CAST(nullif(count(verdict), 0) AS DOUBLE), 1.0), 6) AS support_rate, count(*) FILTER (verdict = 'CONTRADICTS') > 0 AS contradiction FROM orders LEFT JOIN v ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def entailment_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an answer's claims that are supported, 1 where it makes none, and whether any is contradicted."""
    k = F.col("l_partkey") % 5
    v = table(spark, sf, "lineitem").filter("l_tax > 0.03").select(F.col("l_orderkey").alias("o_orderkey"), F.when(k == 0, "CONTRADICTS").when(k == 1, "IRRELEVANT").otherwise("SUPPORTS").alias("verdict"))
    g = v.groupBy("o_orderkey").agg(F.count("verdict").alias("claims"), F.count_if(F.col("verdict") == "SUPPORTS").alias("s"), F.count_if(F.col("verdict") == "CONTRADICTS").alias("c"))
    j = table(spark, sf, "orders").select("o_orderkey").join(g, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce("claims", F.lit(0)).alias("claims"), F.round(F.coalesce(F.try_divide("s", "claims"), F.lit(1.0)), 6).alias("support_rate"), (F.coalesce("c", F.lit(0)) > 0).alias("contradiction"))


@registry.query("""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (a <> b) AS moved, max(abs(a - b)) AS farthest FROM r GROUP BY l_orderkey""")
def position_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a rerank moves, and how far."""
    place = lambda c: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(c), "l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    r = table(spark, sf, "lineitem").select("l_orderkey", place("l_extendedprice").alias("a"), place("l_quantity").alias("b"))
    return r.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("moved"), F.max(F.abs(F.col("a") - F.col("b"))).alias("farthest"))


@registry.query("""WITH d AS (SELECT p_brand AS wage_key, p_partkey AS role, p_size % 10 = 0 AS is_default, p_size > 5 AS ready, p_size % 7 = 0 AS unresolved FROM part)
SELECT 'default_not_ready' AS violation, CAST(role AS VARCHAR) AS subject FROM d WHERE is_default AND NOT ready UNION ALL SELECT 'default_unresolved', CAST(role AS VARCHAR) FROM d WHERE is_default AND unresolved UNION ALL SELECT 'several_defaults', wage_key FROM d WHERE is_default GROUP BY wage_key HAVING count(*) > 1 UNION ALL SELECT 'no_default', wage_key FROM d GROUP BY wage_key HAVING NOT bool_or(is_default)""")
def role_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults that aren't ready or resolved; wage keys with several defaults, or none."""
    d = table(spark, sf, "part").select(F.col("p_brand").alias("wage_key"), F.col("p_partkey").cast("string").alias("role"), (F.col("p_size") % 10 == 0).alias("is_default"), (F.col("p_size") > 5).alias("ready"), (F.col("p_size") % 7 == 0).alias("unresolved"))
    found = F.array_compact(F.array(F.when(~F.col("ready"), "default_not_ready"), F.when(F.col("unresolved"), "default_unresolved")))
    rows = d.filter("is_default").select(F.explode(found).alias("violation"), F.col("role").alias("subject"))
    n = d.groupBy("wage_key").agg(F.count_if("is_default").alias("n"))
    keys = n.select(F.when(F.col("n") > 1, "several_defaults").when(F.col("n") == 0, "no_default").alias("violation"), F.col("wage_key").alias("subject")).filter("violation IS NOT NULL")
    return rows.unionByName(keys)


@registry.query("""WITH a AS (SELECT o_orderkey AS patch, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F') SELECT patch, day FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = patch AND l_shipdate >= TIMESTAMP '1993-06-01')""")
def amendment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Applied operations without a row of their patch."""
    li = table(spark, sf, "lineitem")
    rows = li.filter(F.col("l_shipdate") >= F.lit("1993-06-01").cast(li.schema["l_shipdate"].dataType)).select(F.col("l_orderkey").alias("patch"))
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("patch"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).join(rows, "patch", "left_anti")


@registry.query(r"""WITH t AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS words, lead(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))) OVER (PARTITION BY conv_id ORDER BY turn, role) AS reply FROM conversations)
SELECT conv_id, turn, greatest(1, words, coalesce(reply, 0)) AS tokens, round(greatest(1, words, coalesce(reply, 0)) / 1000.0::DOUBLE * 0.01::DOUBLE, 6) AS cost FROM t WHERE role = 'user'""")
def usage_metering(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a question and its answer, the larger of both, and what they cost."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", words.alias("words")).withColumn("reply", F.lead("words").over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    tokens = F.greatest(F.lit(1).cast("bigint"), F.col("words"), F.coalesce("reply", F.lit(0).cast("bigint")))
    return c.filter("role = 'user'").select("conv_id", "turn", tokens.alias("tokens"), F.round(tokens / 1000.0 * 0.01, 6).alias("cost"))


@registry.query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), t AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_second FROM events WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT event_type, max(value) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(value) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM s GROUP BY 1) SELECT * FROM t JOIN p USING (event_type)""")
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, least, most, rate and nearest-rank percentiles."""
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    t = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.count(F.lit(1)) / (F.max(at) - F.min(at)), 9).alias("per_second"))
    return t.join(metrics.nearest_rank(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "event_type")


@registry.query("""WITH x AS (SELECT p_brand AS article, p_type AS concept, p_partkey FROM part) SELECT article, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts, count(DISTINCT concept) AS n FROM x GROUP BY article""")
def concept_index(spark: SparkSession, sf: str) -> DataFrame:
    """The concepts of each article, sorted."""
    x = table(spark, sf, "part").select(F.col("p_brand").alias("article"), F.col("p_type").alias("concept")).distinct()
    return x.groupBy("article").agg(F.array_join(F.array_sort(F.collect_list("concept")), ",").alias("concepts"), F.count(F.lit(1)).alias("n"))


@registry.query("""WITH x AS (SELECT DISTINCT lower(p_name) AS alias, p_brand AS canonical FROM part), m AS (SELECT alias, max(canonical) AS canonical, count(*) AS claimed FROM x GROUP BY alias) SELECT alias, canonical, claimed FROM m""")
def lexicon_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """One canonical per alias: of several that claim it the last in order."""
    x = table(spark, sf, "part").select(F.lower("p_name").alias("alias"), F.col("p_brand").alias("canonical")).distinct()
    return x.groupBy("alias").agg(F.max("canonical").alias("canonical"), F.count(F.lit(1)).alias("claimed"))


@registry.query("""WITH h AS (SELECT p_type AS topic, p_brand AS article, sum(CASE WHEN contains(p_name, 'red') THEN 4 ELSE 0 END + CASE WHEN contains(p_name, 'steel') THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 1.25 ELSE 0 END)::DOUBLE AS points, bool_or(contains(p_name, 'red')) AS titled FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY titled DESC, points DESC, article) AS place FROM h WHERE points > 0) SELECT topic, article, points, place FROM r WHERE place <= 4""")
def topic_article_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of each topic by weighted hits, those hit in the title first, four at most."""
    has = lambda w, n: F.when(F.col("p_name").contains(w), n).otherwise(0)
    points = has("red", 4) + has("steel", 2) + F.when(F.col("p_size") % 5 == 0, 1.25).otherwise(0)
    h = table(spark, sf, "part").groupBy(F.col("p_type").alias("topic"), F.col("p_brand").alias("article")).agg(F.sum(points).cast("double").alias("points"), F.bool_or(F.col("p_name").contains("red")).alias("titled")).filter("points > 0")
    return windows.top_per_key(h, ["topic"], [F.desc("titled"), F.desc("points"), F.col("article")], 4, "place").select("topic", "article", "points", F.col("place").cast("bigint").alias("place"))


@registry.query("""WITH q AS (SELECT p_partkey % 20 AS article, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), s AS (SELECT article, max(CAST(len(list_intersect(w, ['red', 'steel', 'bolt'])) AS DOUBLE) / (len(w) + 3 - len(list_intersect(w, ['red', 'steel', 'bolt'])))) AS similarity FROM q GROUP BY article)
SELECT article, round(similarity, 6) AS similarity FROM s WHERE similarity > 0.1""")
def question_similarity_max(spark: SparkSession, sf: str) -> DataFrame:
    """The best Jaccard similarity of an article's questions with a question, where it is above 0.1."""
    w = F.array_distinct(F.split(F.lower("p_name"), " "))
    both = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in ("red", "steel", "bolt")])))
    s = table(spark, sf, "part").groupBy((F.col("p_partkey") % 20).alias("article")).agg(F.max(both / (F.size(w) + 3 - both)).alias("s"))
    return s.filter("s > 0.1").select("article", F.round("s", 6).alias("similarity"))


@registry.query("""WITH p AS (SELECT p_partkey, p_brand, regexp_matches(p_name, 'red|blue') AS cited, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS section FROM part), k AS (SELECT p_brand, list(DISTINCT section) AS known FROM p WHERE NOT cited GROUP BY 1)
SELECT p_brand, count(DISTINCT section) FILTER (list_contains(known, section)) AS valid, count(DISTINCT section) FILTER (NOT list_contains(known, section)) AS invalid FROM p JOIN k USING (p_brand) WHERE cited AND section IS NOT NULL GROUP BY p_brand""")
def citation_split(spark: SparkSession, sf: str) -> DataFrame:
    """Cited sections that the context holds, and those that it doesn't: a semi and an anti join told by one left join."""
    p = table(spark, sf, "part").select("p_brand", F.col("p_name").rlike("red|blue").alias("cited"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("section")).filter("section IS NOT NULL")
    known = p.filter("NOT cited").select("p_brand", "section").distinct().withColumn("known", F.lit(True))
    j = p.filter("cited").select("p_brand", "section").distinct().join(known, ["p_brand", "section"], "left")
    return j.groupBy("p_brand").agg(F.count_if(F.col("known").isNotNull()).alias("valid"), F.count_if(F.col("known").isNull()).alias("invalid"))
