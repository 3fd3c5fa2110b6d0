"""Masks, prompts and sources as text; dates by default; flags of conversations; effective outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal as L
from ..operators import windows
from ..sources.tables import table
from .ranking import citations
from .questions import CLAUSES_SQL, clauses
from .registry import Registry
from .routing import _ACTIVE, _TOPIC_HITS, TOPIC_SQL, WAGE_SQL, _ASKED, _CLAUSE, _OF_ROLE, _or, _PERSONAL

registry = Registry()
TODAY = "1997-03-01"


def mask_inline_tags(text: Column) -> Column:
    """Tags within a line as blanks of the same length, so that places in the text stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"(<[^>\n]+>|[^<]+|<)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^<[^>\n]+>$"), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")


@registry.query(r"""WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '\s+', ' ', 'g') AS t FROM pages), p AS (SELECT page_id, t, regexp_extract_all(t, '<[^>\n]+>|[^<]+|<') AS l FROM h)
SELECT page_id, sha256(array_to_string(list_transform(l, lambda p: CASE WHEN regexp_full_match(p, '<[^>\n]+>') THEN repeat(' ', length(p)) ELSE p END), '')) AS masked_sha256, length(t) AS n_chars FROM p""")
def inline_tag_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with their white space made even first; the mask keeps the length."""
    h = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), r"\s+", " ").alias("t")).withColumn("m", mask_inline_tags(F.col("t")))
    return h.select("page_id", F.sha2("m", 256).alias("masked_sha256"), F.length("m").cast("bigint").alias("n_chars"))


@registry.query(f"""WITH {CLAUSES_SQL}, r AS (SELECT article, clause_id, row_number() OVER (PARTITION BY article ORDER BY clause_id) AS r, '**Article ' || article || ', Section ' || (clause_id % 9) || '**:' || chr(10) || substr(text, 1, 60) || chr(10) AS part FROM c)
SELECT article, string_agg(part, chr(10) || '---' || chr(10) ORDER BY r) AS context FROM r WHERE r <= 5 GROUP BY article""")
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    """The first five clauses of an article as a prompt's context: citation, capped text, rules between."""
    c = windows.top_per_key(clauses(spark, sf), ["article"], [F.col("clause_id")], 5, "r")
    part = F.concat(F.lit("**Article "), F.col("article").cast("string"), F.lit(", Section "), (F.col("clause_id") % 9).cast("string"), F.lit("**:\n"), F.substring("text", 1, 60), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", part.alias("part")))), lambda x: x["part"])
    return c.groupBy("article").agg(F.array_join(parts, "\n---\n").alias("context"))


@registry.query(rf"""WITH {CLAUSES_SQL}, m AS (SELECT clause_id, text, regexp_extract_all(lower(text), 'article\s+\d+(?:\s*,?\s*section\s+\d+)?') AS m FROM c),
f AS (SELECT clause_id, text, list_transform(m, lambda x: 'Article ' || regexp_extract(x, 'article\s+(\d+)', 1) || CASE WHEN regexp_extract(x, 'section\s+(\d+)', 1) <> '' THEN ', Section ' || regexp_extract(x, 'section\s+(\d+)', 1) ELSE '' END) AS l FROM m),
d AS (SELECT clause_id, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM f)
SELECT clause_id, text || CASE WHEN clause_id % 4 = 0 AND NOT contains(lower(text), 'union') THEN ' Contact your steward.' ELSE '' END AS answer, array_to_string(list_concat(l, CASE WHEN clause_id % 3 = 0 THEN ['Appendix A', 'Appendix A, Table t' || (clause_id % 5) || ', Row ' || (clause_id % 7 + 1)] ELSE CAST([] AS VARCHAR[]) END), '; ') AS sources FROM d""")
def answer_with_sources(spark: SparkSession, sf: str) -> DataFrame:
    """An answer, with the way to a steward where it is due and missing, and its sources: citations, then the wage table's rows."""
    k, text = F.col("clause_id"), F.col("text")
    wage = F.array(F.lit("Appendix A"), F.concat(F.lit("Appendix A, Table t"), (k % 5).cast("string"), F.lit(", Row "), (k % 7 + 1).cast("string")))
    due = (k % 4 == 0) & ~F.lower(text).contains("union")
    sources = F.concat(citations(text), F.when(k % 3 == 0, wage).otherwise(F.array().cast("array<string>")))
    return clauses(spark, sf).select(k, F.concat(text, F.when(due, " Contact your steward.").otherwise("")).alias("answer"), F.array_join(F.array_distinct(sources), "; ").alias("sources"))


@registry.query(f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN '199' || (c_custkey % 8) || '-06-01' ELSE '{TODAY}' END AS asked FROM customer), j AS (SELECT r.c_custkey, asked, strftime(o_orderdate, '%Y-%m-%d') AS d FROM r JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, asked, coalesce(max(d) FILTER (d <= asked), max(d)) AS effective FROM j GROUP BY ALL""")
def asof_default_today(spark: SparkSession, sf: str) -> DataFrame:
    """The latest date not after the one asked for, today where none is, else the last: one aggregate behind the join."""
    asked = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("199"), (F.col("c_custkey") % 8).cast("string"), F.lit("-06-01"))).otherwise(TODAY)
    r = table(spark, sf, "customer").select("c_custkey", asked.alias("asked"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return r.join(o, "c_custkey").groupBy("c_custkey", "asked").agg(F.coalesce(F.max(F.when(F.col("d") <= F.col("asked"), F.col("d"))), F.max("d")).alias("effective"))


@registry.query("""WITH p AS (SELECT conv_id, count(*) AS pages, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS empty, sum(length(trim(coalesce(text, ''))))::BIGINT AS chars FROM conversations GROUP BY conv_id)
SELECT conv_id, pages, round(empty / CAST(pages AS DOUBLE), 6) AS empty_ratio, round(chars / CAST(pages AS DOUBLE), 6) AS chars_per_page, CASE WHEN chars = 0 THEN 'high' WHEN chars / CAST(pages AS DOUBLE) < 200 OR empty / CAST(pages AS DOUBLE) >= 0.4 THEN 'medium' ELSE 'low' END AS scan_likelihood FROM p""")
def scan_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a document was scanned, by its empty pages and characters a page; turns are the pages of a conversation."""
    chars = F.length(F.trim(F.coalesce("text", F.lit(""))))
    p = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(chars == 0).alias("empty"), F.sum(chars).alias("chars"))
    empty, density = F.col("empty") / F.col("pages"), F.col("chars") / F.col("pages")
    kind = F.when(F.col("chars") == 0, "high").when((density < 200) | (empty >= 0.4), "medium").otherwise("low")
    return p.select("conv_id", "pages", F.round(empty, 6).alias("empty_ratio"), F.round(density, 6).alias("chars_per_page"), kind.alias("scan_likelihood"))


_NORM = "trim(regexp_replace(regexp_replace(replace(replace(lower(text), '’', ''''), '`', ''''), '([a-z0-9_])''([a-z0-9_])', '\\1\\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@registry.query(f"""WITH n AS (SELECT conv_id, turn, role, lower(text) AS low, {_NORM} AS norm FROM conversations WHERE text IS NOT NULL), t AS (SELECT *, {TOPIC_SQL} AS topic FROM n),
w AS (SELECT *, ({WAGE_SQL} > 0 AND NOT (coalesce(topic IN {L.WAGE_SUPPRESSED_TOPICS}, FALSE) AND NOT {_PERSONAL} AND NOT {_ASKED}) AND NOT ({_CLAUSE} AND NOT {_PERSONAL} AND NOT {_OF_ROLE})) AS wage FROM t)
SELECT conv_id, turn, role, topic, CASE WHEN {_or(_TOPIC_HITS + _ACTIVE)} THEN 'high_stakes' WHEN wage THEN 'wage' ELSE 'contract' END AS intent, regexp_matches(low, '[?]\\s*$') AS question FROM w""")
def intent_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Topic, intent and question mark of every message."""
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", "role", L.first_topic(F.col("text")).alias("topic"), L.intent(F.col("text")).alias("intent"), F.lower("text").rlike(r"[?]\s*\z").alias("question"))


@registry.query("""WITH v AS (SELECT p_brand, p_size, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part) SELECT p_brand AS contract, count(*) AS rows_, count(DISTINCT p_size) AS sections, sha256(string_agg('## ' || p_size || chr(10) || p_name, chr(10) || chr(10) ORDER BY p_size, p_partkey)) AS markdown_sha256 FROM v GROUP BY p_brand""")
def effective_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The effective text of each contract as markdown: a contract is the unit of what is written."""
    part = F.concat(F.lit("## "), F.col("p_size").cast("string"), F.lit("\n"), "p_name")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p_size", "p_partkey", part.alias("t")))), lambda x: x["t"])
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("contract")).agg(F.count(F.lit(1)).alias("rows_"), F.count_distinct("p_size").alias("sections"), F.sha2(F.array_join(texts, "\n\n"), 256).alias("markdown_sha256"))
