"""Wage rows, flags, provenance marks, prompt and output scans, conversation memory, purges and misses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diffs, windows
from ..operators import wage_rows as R
from ..sources.tables import table
from .questions import CLAUSES_SQL, clauses
from .registry import Registry
from .routing import _re
from .safety import redaction_steps

registry = Registry()


def wage_table(spark: SparkSession, sf: str) -> DataFrame:
    """A wage table per brand, a row per part."""
    k, n = F.col("p_partkey"), F.col("p_name")
    money = lambda d: F.concat(F.lit("$"), (F.col("p_size") + d).cast("string"), F.lit(".25"))
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    kinds = [
        row("-", "", "--"), row("Classification", "Effective 1/2/22", "3/4/23"), row("Rates", "1/2/22", "3/4/2023"), row("HEAD CLERK", "", ""), row("After 500 hours", money(0), money(1)),
        row(F.concat(F.lit("<b>"), n, F.lit("</b> lead")), "", ""), row("Start", "-", "-"), row(n, money(2), money(3)), row(n, money(4), "n/a"), row(n, "words", "12%"), row("Thereafter", "$1,200.50", "9"),
    ]
    cells = reduce(lambda w, i: w.when(k % 11 == i, kinds[i]), range(1, 11), F.when(k % 11 == 0, kinds[0]))
    return table(spark, sf, "part").select((k % 40).alias("doc"), k, cells.alias("cells"))


_D = r"\d{1,2}/\d{1,2}/\d{2,4}"
WAGE_TABLE = """w AS (SELECT p_partkey % 40 AS doc, p_partkey, CASE p_partkey % 11 WHEN 0 THEN ['-', '', '--'] WHEN 1 THEN ['Classification', 'Effective 1/2/22', '3/4/23'] WHEN 2 THEN ['Rates', '1/2/22', '3/4/2023'] WHEN 3 THEN ['HEAD CLERK', '', '']
WHEN 4 THEN ['After 500 hours', '$' || p_size || '.25', '$' || (p_size + 1) || '.25'] WHEN 5 THEN ['<b>' || p_name || '</b> lead', '', ''] WHEN 6 THEN ['Start', '-', '-'] WHEN 7 THEN [p_name, '$' || (p_size + 2) || '.25', '$' || (p_size + 3) || '.25']
WHEN 8 THEN [p_name, '$' || (p_size + 4) || '.25', 'n/a'] WHEN 9 THEN [p_name, 'words', '12%'] ELSE ['Thereafter', '$1,200.50', '9'] END AS cells FROM part),
f AS (SELECT *, CASE p_partkey % 11 WHEN 0 THEN 'separator' WHEN 1 THEN 'header' WHEN 2 THEN 'effective_date' WHEN 3 THEN 'classification_header' WHEN 4 THEN 'step_row' WHEN 5 THEN 'classification_header' WHEN 6 THEN 'non_wage' WHEN 7 THEN 'rate_row' WHEN 8 THEN 'ambiguous_rate_like' WHEN 9 THEN 'non_wage' ELSE 'step_row' END AS t FROM w)"""


@registry.query(f"""WITH {WAGE_TABLE}, s AS (SELECT *, last_value(CASE WHEN t = 'classification_header' THEN trim(regexp_replace(regexp_replace(cells[1], '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) END IGNORE NULLS) OVER o AS active_class, last_value(CASE WHEN t = 'effective_date' THEN '1/2/22,3/4/2023' END IGNORE NULLS) OVER o AS dates FROM f WINDOW o AS (PARTITION BY doc ORDER BY p_partkey ROWS UNBOUNDED PRECEDING))
SELECT doc, p_partkey, CASE WHEN t = 'step_row' AND active_class IS NULL THEN 'ambiguous_step' ELSE t END AS row_type, active_class, dates FROM s""")
def wage_row_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Row types by ordered rules, with the class and the dates that hold: the SQL knows each kind's type by how it was made."""
    return R.scan(wage_table(spark, sf), "doc", "p_partkey", "cells", 3).select("doc", "p_partkey", "row_type", "active_class", "dates")


# What makes a section an exception, a definition, one of dates of hire, or one of high stakes.
FLAGS = {
    "is_exception": r"\bexcept\b|\bunless\b|\bnotwithstanding\b|shall not apply|does not apply|excluded from",
    "is_definition": r"shall (mean|be defined|have the meaning)|is defined as|means|refers to|the term .* shall|for purposes of this",
    "hire_date_sensitive": r"march 27,? 2005|march 26,? 2005|hired (on or )?before|hired (on or )?after|employees hired prior|employees hired after",
    "is_high_stakes": r"discharge|terminat|fired|disciplin|suspend|warning|harass|discriminat|safety|injury|hazard|grievance|arbitration",
}
PHRASES = ("unless hired on or before 1990", "this means more", "the term food shall be wide", "a warning", "plain")


@registry.query(f"""WITH {CLAUSES_SQL}, t AS (SELECT clause_id, lower(text || ' ' || ['unless hired on or before 1990', 'this means more', 'the term food shall be wide', 'a warning', 'plain'][clause_id % 5 + 1]) AS low FROM c) SELECT clause_id, {", ".join(f"{_re('low', p)} AS {n}" for n, p in FLAGS.items())} FROM t""")
def section_flags(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower(F.concat("text", F.lit(" "), F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("clause_id") % 5 + 1).cast("int"))))
    return clauses(spark, sf).select("clause_id", *[low.rlike(p).alias(n) for n, p in FLAGS.items()])


@registry.query(r"""WITH t AS (SELECT p_partkey, 'PROV(span_id=s' || p_partkey || ', page=' || p_size || ', sources=[a.pdf#p1; b.pdf#p' || p_size || ']) ' || p_name || chr(10) || ' 9 NORTH STORES 2022-2025 ' || 'rest' AS t FROM part), b AS (SELECT p_partkey, t, regexp_extract(t, 'PROV\(([^)]*)\)', 1) AS b FROM t)
SELECT p_partkey, regexp_extract(b, 'span_id=([^,)\]]*)', 1) AS span_id, CAST(regexp_extract(b, 'page=(\d+)', 1) AS INT) AS page, len(string_split(regexp_extract(b, 'sources=\[([^\]]*)\]', 1), ';')) AS sources,
trim(regexp_replace(regexp_replace(regexp_replace(t, 'PROV\([^)]*\)\s*', ' ', 'g'), '\s*\d{1,4}\s*[A-Z][A-Z0-9 \-&''/]{3,60}?\s+\d{4}\s*-\s*\d{4}\s*', ' ', 'g'), '[ \t]{2,}', ' ', 'g')) AS text FROM b""")
def provenance_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the mark that owns a passage, and the passage without marks and page furniture."""
    p = F.col("p_size").cast("string")
    t = F.concat(F.lit("PROV(span_id=s"), F.col("p_partkey").cast("string"), F.lit(", page="), p, F.lit(", sources=[a.pdf#p1; b.pdf#p"), p, F.lit("]) "), "p_name", F.lit("\n 9 NORTH STORES 2022-2025 rest"))
    d = table(spark, sf, "part").select("p_partkey", t.alias("t")).withColumn("b", F.regexp_extract("t", r"PROV\(([^)]*)\)", 1))
    text = F.regexp_replace(F.regexp_replace("t", r"PROV\([^)]*\)\s*", " "), r"\s*\d{1,4}\s*[A-Z][A-Z0-9 \-&'/]{3,60}?\s+\d{4}\s*[-–—]\s*\d{4}\s*(?:[-–—]{2,}\s*)?", " ")
    return d.select(
        "p_partkey", F.regexp_extract("b", r"span_id=([^,)\]]*)", 1).alias("span_id"), F.regexp_extract("b", r"page=(\d+)", 1).cast("int").alias("page"),
        F.size(F.split(F.regexp_extract("b", r"sources=\[([^\]]*)\]", 1), ";")).cast("bigint").alias("sources"), F.trim(F.regexp_replace(text, "[ \t]{2,}", " ")).alias("text"),
    )


#: Fixed value: words that a prompt may have.
TOKEN_LIMIT = 4000
_LABELS = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{label}' END" for label, p in T.INJECTION) + "], lambda x: x IS NOT NULL)))"


@registry.query(f"""WITH s AS (SELECT doc_id, {_LABELS} AS labels, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) > 4000 AS long FROM documents)
SELECT doc_id, len(labels) = 0 AND NOT long AS allowed, array_to_string(list_concat(labels, CASE WHEN long THEN ['token_limit'] ELSE CAST([] AS VARCHAR[]) END), ',') AS reasons, CASE WHEN long THEN 1.0 WHEN len(labels) > 0 THEN 0.95 ELSE 0.0 END AS risk FROM s""")
def prompt_decision(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt passes if nothing speaks against it; the risk is the largest of its reasons. Texts of more than 4000 words don't pass."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    s = table(spark, sf, "documents").select("doc_id", T.injection_labels(F.col("text")).alias("labels"), (words > TOKEN_LIMIT).alias("long"))
    reasons = F.concat("labels", F.when(F.col("long"), F.array(F.lit("token_limit"))).otherwise(F.array().cast("array<string>")))
    risk = F.when(F.col("long"), 1.0).when(F.size("labels") > 0, 0.95).otherwise(0.0)
    return s.select("doc_id", (F.size(reasons) == 0).alias("allowed"), F.array_join(reasons, ",").alias("reasons"), risk.alias("risk"))


#: Answers as they are, and with personal data of each class put into some of them.
_LEAKS = ("", " call 303-555-0147 now", " ssn 123-45-6789", " DOB: 04/05/1980", " address: 12 Elm Hill Road", " routing number 123456789", " acct # 12345678", " card 4111 1111 1111 1111", " member id AB-12345", " password is hunter22", " nothing of it")
_ANSWERS = "t0 AS (SELECT conv_id, turn, role, text AS raw, coalesce(text, '') || [" + ", ".join(f"'{x}'" for x in _LEAKS) + f"][CAST((conv_id * 7 + turn) % {len(_LEAKS)} AS INT) + 1] AS x, CAST([] AS VARCHAR[]) AS classes FROM conversations WHERE role = 'assistant')"


@registry.query(f"WITH {_ANSWERS}, {redaction_steps('conv_id, turn, role')} SELECT conv_id, turn, role, len(classes) = 0 AS allowed, array_to_string(list_sort(classes), ',') AS classes FROM t10")
def output_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that may pass: those in which no class of personal data is found."""
    leak = F.element_at(F.array(*[F.lit(x) for x in _LEAKS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(_LEAKS) + 1).cast("int"))
    c = table(spark, sf, "conversations").filter("role = 'assistant'").withColumn("answer", F.concat(F.coalesce("text", F.lit("")), leak))
    found = c.select("conv_id", "turn", "role", T.redacted_classes(F.col("answer")).alias("found"))
    return found.select("conv_id", "turn", "role", (F.size("found") == 0).alias("allowed"), F.array_join("found", ",").alias("classes"))


@registry.query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'topic' || (turn % 5) END AS topic, CASE WHEN turn % 4 = 1 THEN 'Article ' || turn END AS cited FROM conversations)
SELECT conv_id, arg_max(topic, turn * 10 + CASE role WHEN 'user' THEN 1 ELSE 2 END) AS last_topic, arg_max(cited, turn * 10 + CASE role WHEN 'user' THEN 1 ELSE 2 END) AS last_cited FROM t GROUP BY conv_id""")
def last_topic_and_citation(spark: SparkSession, sf: str) -> DataFrame:
    """What a conversation spoke of and cited last: the last that isn't null."""
    at = F.col("turn") * 10 + F.when(F.col("role") == "user", 1).otherwise(2)
    topic = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("topic"), (F.col("turn") % 5).cast("string")))
    cited = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Article "), F.col("turn").cast("string")))
    c = table(spark, sf, "conversations").select("conv_id", at.alias("at"), topic.alias("topic"), cited.alias("cited"))
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("at")))
    return c.groupBy("conv_id").agg(last("topic").alias("last_topic"), last("cited").alias("last_cited"))


@registry.query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 7), o AS (SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT * FROM gone) THEN NULL ELSE o_custkey END AS o_custkey FROM orders), e AS (SELECT event_id FROM events WHERE NOT (user_id IN (SELECT * FROM gone) OR event_id % 1000 IN (SELECT * FROM gone)))
SELECT 'customer' AS tab, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)) AS n, 0 AS blanked UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_custkey IS NULL) FROM o UNION ALL SELECT 'events', count(*), 0 FROM e""")
def purge_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    """Users purged from all tables: their own rows go, orders lose their owner, events go by user or by session."""
    c, o, e = table(spark, sf, "customer"), table(spark, sf, "orders"), table(spark, sf, "events")
    gone = c.filter("c_custkey % 50 = 7").select(F.col("c_custkey").alias("gone"))
    left = c.join(gone, c.c_custkey == gone.gone, "left_anti").agg(F.lit("customer").alias("tab"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("blanked"))
    owned = o.join(gone, o.o_custkey == gone.gone, "left").agg(F.lit("orders").alias("tab"), F.count(F.lit(1)).alias("n"), F.count("gone").alias("blanked"))
    kept = e.join(gone, e.user_id == gone.gone, "left_anti").withColumn("session", F.col("event_id") % 1000)
    kept = kept.join(gone, kept.session == gone.gone, "left_anti").agg(F.lit("events").alias("tab"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("blanked"))
    return left.unionAll(owned).unionAll(kept)


@registry.query("""WITH m AS (SELECT p_partkey, ['High', ' low ', 'odd', NULL][p_partkey % 4 + 1] AS severity, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_name END AS question, p_size FROM part)
SELECT 'miss_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS miss_id, CASE WHEN lower(trim(severity)) IN ('high', 'medium', 'low') THEN lower(trim(severity)) ELSE 'medium' END AS severity, substr(trim(question), 1, 10) AS question, greatest(0, least(p_size - 10, 25)) AS rank FROM m WHERE trim(question) <> ''""")
def miss_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of misses made even: known severities, capped texts, bounded ranks; those without a question go."""
    k = F.col("p_partkey")
    severity = F.lower(F.trim(F.element_at(F.array(F.lit("High"), F.lit(" low "), F.lit("odd"), F.lit(None)), (k % 4 + 1).cast("int"))))
    m = table(spark, sf, "part").select(k, severity.alias("s"), F.trim(F.when(k % 3 == 0, "  ").otherwise(F.col("p_name"))).alias("q"), "p_size").filter("q != ''")
    known = F.when(F.col("s").isin("high", "medium", "low"), F.col("s")).otherwise("medium")
    return m.select(F.concat(F.lit("miss_"), F.lpad(k.cast("string"), 6, "0")).alias("miss_id"), known.alias("severity"), F.substring("q", 1, 10).alias("question"), F.greatest(F.lit(0), F.least(F.col("p_size") - 10, F.lit(25))).alias("rank"))


@registry.query("""WITH c AS (SELECT p_partkey AS chunk, p_size % 10 AS article, p_name AS text FROM part WHERE p_partkey % 2 = 0), t AS (SELECT p_partkey AS tab, p_size % 12 AS article FROM part WHERE p_partkey % 16 = 1), f AS (SELECT article, min(chunk) AS chunk FROM c GROUP BY 1),
a AS (SELECT tab, t.article, chunk FROM t LEFT JOIN f USING (article)) SELECT chunk, article, string_agg(CAST(tab AS VARCHAR), ',' ORDER BY tab) AS tables, FALSE AS made FROM a WHERE chunk IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, article, CAST(tab AS VARCHAR), TRUE FROM a WHERE chunk IS NULL""")
def table_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Tables put to the first chunk of their article; a chunk of its own is made for one without any."""
    p = table(spark, sf, "part")
    first = p.filter("p_partkey % 2 = 0").groupBy((F.col("p_size") % 10).alias("article")).agg(F.min("p_partkey").alias("chunk"))
    t = p.filter("p_partkey % 16 = 1").select(F.col("p_partkey").alias("tab"), (F.col("p_size") % 12).alias("article")).join(first, "article", "left")
    held = t.filter("chunk IS NOT NULL").groupBy("chunk", "article").agg(F.array_join(F.array_sort(F.collect_list("tab")), ",").alias("tables"), F.lit(False).alias("made"))
    return held.unionByName(t.filter("chunk IS NULL").select("chunk", "article", F.col("tab").cast("string").alias("tables"), F.lit(True).alias("made")))


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and a later version of them: words changed, each eleventh line by its hash gone and a line added behind each thirteenth."""
    cut = F.split("text", "\n")
    edit = lambda x: F.when(F.crc32(x) % 13 == 0, F.concat(x, F.lit("\nadded behind it"))).otherwise(F.replace(x, F.lit("the "), F.lit("THE ")))
    later = F.array_join(F.transform(F.filter(cut, lambda x: F.crc32(x) % 11 != 0), edit), "\n")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "text", later.alias("later"))


@registry.query()
def diff_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve lines of a unified diff between versions of a text, of those that changed."""
    return diffs.unified(diffs.hunks(diffs.line_diff(_changed(spark, sf), "doc_id", "text", "later"), "doc_id", 1), "doc_id", 12)


@registry.query("""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS base_lines, TRUE AS same FROM d""")
def diff_rebuilds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the script of each document gives back both of its versions, line by line."""
    d = _changed(spark, sf)
    script = diffs.line_diff(d, "doc_id", "text", "later")
    sides = script.groupBy("doc_id").agg(
        *[F.xxhash64(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") != skip, F.struct("place", "line")))), lambda x: x["line"])).alias(name) for skip, name in (("+", "old"), ("-", "new"))],
        F.sum((F.col("op") != "+").cast("bigint")).alias("base_lines"),
    )
    nothing = F.xxhash64(F.array().cast("array<string>"))
    whole = lambda side: F.xxhash64(diffs.cut_lines(F.col(side)))
    want = d.select("doc_id", whole("text").alias("was"), whole("later").alias("is")).join(sides, "doc_id", "left")
    eq = lambda a, b: F.coalesce(a, nothing) == F.coalesce(b, nothing)
    return want.select("doc_id", F.coalesce("base_lines", F.lit(0)).alias("base_lines"), (eq(F.col("old"), F.col("was")) & eq(F.col("new"), F.col("is"))).alias("same"))


@registry.query("""WITH t AS (SELECT p_type AS topic, p_brand AS article, count(*) AS n FROM part WHERE p_size < 20 GROUP BY ALL), o(topic, article) AS (VALUES ('SMALL', 'Brand#3'), ('NEW', 'Brand#1')), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, article) AS r FROM t), g AS (SELECT topic, string_agg(article, ',' ORDER BY r) AS articles FROM r WHERE r <= 3 GROUP BY 1)
SELECT coalesce(g.topic, o.topic) AS topic, coalesce(o.article, g.articles) AS articles, o.topic IS NOT NULL AS overridden FROM g FULL JOIN o ON g.topic = o.topic""")
def query_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Articles per topic from what the texts hold, with a manifest's own routes over them."""
    t = table(spark, sf, "part").filter("p_size < 20").groupBy(F.col("p_type").alias("topic"), F.col("p_brand").alias("article")).agg(F.count(F.lit(1)).alias("n"))
    top = windows.top_per_key(t, ["topic"], [F.desc("n"), F.col("article")], 3, "r")
    g = top.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "article"))), lambda x: x["article"]), ",").alias("articles"))
    o = spark.createDataFrame([("SMALL", "Brand#3"), ("NEW", "Brand#1")], "topic string, own string")
    j = g.join(o, "topic", "full_outer")
    return j.select("topic", F.coalesce("own", "articles").alias("articles"), F.col("own").isNotNull().alias("overridden"))


@registry.query("""WITH v AS (SELECT p_brand AS contract, p_size AS version, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL), w AS (SELECT *, lag(version) OVER (PARTITION BY contract ORDER BY version) AS parent, row_number() OVER (PARTITION BY contract ORDER BY version DESC) = 1 AS current FROM v) SELECT contract, version, parent, n, current FROM w""")
def version_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of each contract with their parents; the last one is in force."""
    v = table(spark, sf, "part").groupBy(F.col("p_brand").alias("contract"), F.col("p_size").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("contract").orderBy("version")
    return v.select("contract", "version", F.lag("version").over(w).alias("parent"), "n", F.lead("version").over(w).isNull().alias("current"))
