"""Scopes, catalogs, role matches, doc types, plan records and comparisons per section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows
from ..sources.tables import table, tenant_scope
from .platform import EV, _events
from .registry import Registry

registry = Registry()


@registry.query(f"WITH {EV} SELECT event_id, nullif(tenant, 0) AS tenant FROM e WHERE nullif(tenant, 0) = 3")
def tenant_rls_hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of no tenant are hidden."""
    e = _events(spark, sf).withColumn("tenant", F.nullif("tenant", F.lit(0)))
    return tenant_scope(e, F.col("tenant"), 3, nulls="hidden").select("event_id", "tenant")


@registry.query("SELECT p_partkey, nullif(p_brand, 'Brand#7') AS contract FROM part WHERE nullif(p_brand, 'Brand#7') = 'Brand#3' AND p_type <> 'LARGE'")
def contract_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the pinned contract; rows of none are never in it."""
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#7")).alias("contract"), "p_type")
    return p.filter((F.col("contract") == "Brand#3") & (F.col("p_type") != "LARGE")).select("p_partkey", "contract")


KEYS = ("red widget", "blue bolt", "green ring", "steel nut", "small gear")
_GRAMS = lambda s: f"list_distinct(list_transform(generate_series(1, length({s}) - 2), lambda i: substr({s}, i, 3)))"


@registry.query(f"""WITH r AS (SELECT DISTINCT p_name AS role FROM part), k AS (SELECT unnest([{", ".join(f"'{k}'" for k in KEYS)}]) AS wage_key), t AS (SELECT role, wage_key, '  ' || lower(trim(role)) || '  ' AS a, '  ' || wage_key || '  ' AS b FROM r, k),
s AS (SELECT role, wage_key, CAST(len(list_intersect({_GRAMS("a")}, {_GRAMS("b")})) AS DOUBLE) / len(list_distinct(list_concat({_GRAMS("a")}, {_GRAMS("b")}))) AS s FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY s DESC, wage_key) AS r, lead(s) OVER (PARTITION BY role ORDER BY s DESC, wage_key) AS second FROM s)
SELECT role, wage_key, round(s, 6) AS similarity, round(s - second, 6) AS margin FROM o WHERE r = 1""")
def role_wage_match(spark: SparkSession, sf: str) -> DataFrame:
    """The wage key that a role is most like, and its margin over the second: scored within the row, over a small array of keys."""
    roles = table(spark, sf, "part").select(F.col("p_name").alias("role")).distinct()
    each = F.array(*[F.struct((-T.token_sets_jaccard(T.trigrams(F.col("role")), T.trigrams(F.lit(k)))).alias("s"), F.lit(k).alias("k")) for k in KEYS])
    ranked = roles.select("role", F.array_sort(each).alias("a"))
    return ranked.select("role", F.col("a")[0]["k"].alias("wage_key"), F.round(-F.col("a")[0]["s"], 6).alias("similarity"), F.round(F.col("a")[1]["s"] - F.col("a")[0]["s"], 6).alias("margin"))


@registry.query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 10 DESC, p_type = 'ECONOMY' DESC, length(p_name), p_size DESC, p_name, p_partkey) AS r FROM part) SELECT p_brand AS wage_key, p_partkey AS role, p_name FROM r WHERE r = 1""")
def role_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """One default role per wage key, by six keys in order."""
    order = [(F.col("p_size") > 10).desc(), (F.col("p_type") == "ECONOMY").desc(), F.length("p_name"), F.desc("p_size"), F.col("p_name"), F.col("p_partkey")]
    top = windows.top_per_key(table(spark, sf, "part"), ["p_brand"], order)
    return top.select(F.col("p_brand").alias("wage_key"), F.col("p_partkey").alias("role"), "p_name")


@registry.query("SELECT o_custkey AS contract, min(o_orderkey) AS document, arg_min(o_orderpriority, o_orderkey) AS title, bool_or(o_orderstatus = 'O') AS ready FROM orders GROUP BY 1")
def member_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One row per contract: its first document, and whether any is ready."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("contract")).agg(F.min("o_orderkey").alias("document"), F.min_by("o_orderpriority", "o_orderkey").alias("title"), F.bool_or(F.col("o_orderstatus") == "O").alias("ready"))


HINTS = (("colour", "red"), ("colour", "blue"), ("metal", "steel"), ("fastener", "bolt"), ("fastener", "nut"))


@registry.query(f"""WITH h(topic, word) AS (VALUES {", ".join(map(str, HINTS))}), m AS (SELECT DISTINCT topic, p_brand AS article FROM h JOIN part ON contains(p_name, word) WHERE p_size <= 12) SELECT topic, string_agg(article, ',' ORDER BY article) AS articles, count(*) AS n FROM m GROUP BY topic""")
def topic_title_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Articles whose titles hold a topic's words; the hints are a literal array of each row."""
    p = table(spark, sf, "part").filter("p_size <= 12").select(F.col("p_brand").alias("article"), "p_name")
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("p_name").contains(w), F.lit(t)) for t, w in HINTS])))
    m = p.select("article", F.explode(found).alias("topic")).distinct()
    return m.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("article")), ",").alias("articles"), F.count(F.lit(1)).alias("n"))


@registry.query("""WITH t AS (SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN ' LOU ' WHEN 1 THEN 'letter of agreement' WHEN 2 THEN 'Side-Letter' WHEN 3 THEN 'cba' WHEN 4 THEN '' ELSE 'appendix A' END AS raw FROM part), n AS (SELECT p_partkey, p_brand, CASE WHEN regexp_matches(lower(trim(raw)), '^(lou|letters? of understanding)') THEN 'lou' WHEN regexp_matches(lower(trim(raw)), '^(loa|letters? of agreement|side.?letter)') THEN 'loa' WHEN starts_with(lower(trim(raw)), 'appendix') THEN 'appendix' ELSE 'cba' END AS doc_type FROM t),
s AS (SELECT DISTINCT p_brand, doc_type FROM n WHERE p_partkey % 10 < 4) SELECT p_partkey, n.doc_type, s.doc_type IS NOT NULL AS supported FROM n LEFT JOIN s ON s.p_brand = n.p_brand AND s.doc_type = n.doc_type""")
def doc_types(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms of document types, and whether a pack holds any of that type."""
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, " LOU ").when(k % 6 == 1, "letter of agreement").when(k % 6 == 2, "Side-Letter").when(k % 6 == 3, "cba").when(k % 6 == 4, "").otherwise("appendix A")
    low = F.lower(F.trim(raw))
    kind = F.when(low.rlike("^(lou|letters? of understanding)"), "lou").when(low.rlike("^(loa|letters? of agreement|side.?letter)"), "loa").when(low.startswith("appendix"), "appendix").otherwise("cba")
    n = table(spark, sf, "part").select(k, "p_brand", kind.alias("doc_type"))
    held = n.filter("p_partkey % 10 < 4").select("p_brand", "doc_type").distinct().withColumn("s", F.lit(True))
    return n.join(held, ["p_brand", "doc_type"], "left").select("p_partkey", "doc_type", F.col("s").isNotNull().alias("supported"))


@registry.query("""SELECT event_id, CAST(json_extract_string('{"topic": "' || event_type || '", "articles": [' || (user_id % 9) || ', 4], "comparison": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}', '$.articles[0]') AS BIGINT) AS first_article, event_type AS topic, event_id % 2 = 0 AS comparison FROM events""")
def plan_records(spark: SparkSession, sf: str) -> DataFrame:
    """Plans of questions to JSON and back; what comes back is read."""
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("topic"), F.array(F.col("user_id") % 9, F.lit(4).cast("bigint")).alias("articles"), (F.col("event_id") % 2 == 0).alias("comparison"))).alias("plan"))
    p = F.from_json("plan", "topic string, articles array<bigint>, comparison boolean")
    return e.select("event_id", p.alias("p")).select("event_id", F.col("p.articles")[0].alias("first_article"), "p.topic", "p.comparison")


@registry.query(r"""WITH b AS (SELECT p_brand, p_size, string_agg(p_name || '  ' || chr(13) || chr(10), ' ' ORDER BY p_partkey) AS t FROM part GROUP BY ALL), n AS (SELECT p_brand, p_size, string_agg(CASE WHEN p_partkey % 17 = 3 THEN p_name || ' new' ELSE p_name END, chr(10) || ' ' ORDER BY p_partkey) AS t FROM part WHERE p_size <> 9 GROUP BY ALL),
c AS (SELECT p_brand, p_size, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM b), d AS (SELECT p_brand, p_size, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM n)
SELECT c.p_brand, c.p_size, CASE WHEN d.t IS NULL THEN 'missing' WHEN c.t = d.t THEN 'same' ELSE 'changed' END AS state FROM c LEFT JOIN d ON d.p_brand = c.p_brand AND d.p_size = c.p_size""")
def section_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Base and effective text of each section, compared with white space made even."""
    p = table(spark, sf, "part")
    joined = lambda t, sep: F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", t.alias("t")))), lambda x: x["t"]), sep), r"\s+", " "))
    b = p.groupBy("p_brand", "p_size").agg(joined(F.concat("p_name", F.lit("  \r\n")), " ").alias("b"))
    n = p.filter("p_size != 9").groupBy("p_brand", "p_size").agg(joined(F.when(F.col("p_partkey") % 17 == 3, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")), "\n ").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("b") == F.col("n"), "same").otherwise("changed")
    return b.join(n, ["p_brand", "p_size"], "left").select("p_brand", "p_size", state.alias("state"))


@registry.query("""WITH c AS (SELECT doc_id, substr(lower(text), 1, 50) AS k FROM documents WHERE text IS NOT NULL), f AS (SELECT k, min(doc_id) AS first, count(*) AS seen FROM c GROUP BY k) SELECT first AS doc_id, seen FROM f""")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The first text of each that begin alike, told by 50 lower-case characters as a claim's key is."""
    c = table(spark, sf, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.substring(F.lower("text"), 1, 50).alias("k"))
    return c.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("seen")).select("doc_id", "seen")


@registry.query("""WITH a AS (SELECT o_custkey AS k, [o_orderkey % 7, o_orderkey % 5] AS own, [o_orderkey % 3, 6] AS asked FROM orders) SELECT k, sum(len(list_intersect(list_distinct(own), list_distinct(asked))))::BIGINT AS overlap, count(*) AS n FROM a GROUP BY k""")
def topic_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How many preferred topics the rows of a key hold."""
    o = F.col("o_orderkey")
    both = F.size(F.array_intersect(F.array(o % 7, o % 5), F.array(o % 3, F.lit(6).cast("bigint"))))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(both).alias("overlap"), F.count(F.lit(1)).alias("n"))


@registry.query("""WITH c AS (SELECT p_brand, p_type = 'LARGE' AS letter, p_size % 3 <> 0 AS paged, p_partkey % 5 = 0 AS patched FROM part) SELECT p_brand, count(*) AS chunks, count(*) FILTER (letter) AS letters, count(*) FILTER (patched) AS patched, count(*) FILTER (paged) AS paged, round(count(*) FILTER (paged) / CAST(count(*) AS DOUBLE), 6) AS page_rate, count(*) FILTER (letter AND NOT paged) AS letters_without_page FROM c GROUP BY 1""")
def pack_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, side letters, patches and pages of each pack: one conditional aggregate."""
    letter, paged = F.col("p_type") == "LARGE", F.col("p_size") % 3 != 0
    return table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(letter).alias("letters"), F.count_if(F.col("p_partkey") % 5 == 0).alias("patched"), F.count_if(paged).alias("paged"),
        F.round(F.count_if(paged) / F.count(F.lit(1)), 6).alias("page_rate"), F.count_if(letter & ~paged).alias("letters_without_page"),
    )


@registry.query("""WITH a AS (SELECT c_custkey, ['name' || c_nationkey, 'a'] AS tenant, ['a', 'name' || (c_custkey % 25), 'b'] AS own FROM customer), m AS (SELECT c_custkey, list_concat(tenant, own) AS l FROM a) SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS aliases FROM m""")
def alias_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A tenant's aliases, then the user's own, each once."""
    name = lambda c: F.concat(F.lit("name"), c.cast("string"))
    both = F.array_distinct(F.concat(F.array(name(F.col("c_nationkey")), F.lit("a")), F.array(F.lit("a"), name(F.col("c_custkey") % 25), F.lit("b"))))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(both, ",").alias("aliases"))


@registry.query("""WITH r AS (SELECT p_brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'blue')) SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY r) AS anchors FROM r WHERE r <= 2 GROUP BY 1""")
def comparison_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Up to two anchors of each contract for a comparison of roles."""
    p = table(spark, sf, "part").filter(F.col("p_name").contains("red") | F.col("p_name").contains("blue"))
    top = windows.top_per_key(p, ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 2, "r")
    anchors = F.transform(F.array_sort(F.collect_list(F.struct("r", "p_partkey"))), lambda x: x["p_partkey"].cast("string"))
    return top.groupBy("p_brand").agg(F.array_join(anchors, ",").alias("anchors"))
