"""Patches from order lines over rows of parts; HTML tables: extraction, hashes, match; drafts and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import patches, tables, windows
from ..sources.tables import table
from .registry import Registry

registry = Registry()


def base_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Forty targets in each of a thousand contracts."""
    return spark.range(1000).select(F.col("id").alias("contract")).select("contract", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("target")).withColumn("value", F.col("contract") * 100 + F.col("target"))


def operations(spark: SparkSession, sf: str) -> DataFrame:
    """A patch per dear order, an operation per line; some expect a stale hash, lack sources or approval, or miss their target."""
    o = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("patch_id"), (F.col("o_custkey") % 1000).alias("contract"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    x = o.join(li, o.patch_id == li.l_orderkey).withColumn("target", F.col("l_linenumber").cast("bigint") * 6 % 43 + F.when(F.col("l_partkey") % 97 == 0, 60).otherwise(0))
    x = x.withColumn("value", F.col("l_partkey") + 1_000_000).withColumn("approved", F.col("l_partkey") % 11 != 0).withColumn("sourced", F.col("l_partkey") % 89 != 0)
    w = Window.partitionBy("contract", "target").orderBy("effective_date", "patch_id", "l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(F.when(F.col("approved"), F.col("value")), True).over(w), F.col("contract") * 100 + F.col("target"))
    expected = F.when(F.col("l_partkey") % 61 == 0, "stale").otherwise(F.sha2(held.cast("string"), 256))
    return x.select("contract", "effective_date", "patch_id", F.col("l_linenumber").alias("op_no"), "target", expected.alias("expected"), "value", "approved", "sourced")


OPS = """o AS (SELECT o_orderkey AS patch_id, o_custkey % 1000 AS contract, strftime(o_orderdate, '%Y-%m-%d') AS effective_date FROM orders WHERE o_totalprice > 300000),
l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), x AS (SELECT o.*, l_linenumber AS op_no, l_partkey, CAST(l_linenumber AS BIGINT) * 6 % 43 + CASE WHEN l_partkey % 97 = 0 THEN 60 ELSE 0 END AS target, l_partkey + 1000000 AS value, l_partkey % 11 <> 0 AS approved, l_partkey % 89 <> 0 AS sourced FROM o JOIN l ON patch_id = l_orderkey),
h AS (SELECT *, coalesce(last_value(CASE WHEN approved THEN value END IGNORE NULLS) OVER (PARTITION BY contract, target ORDER BY effective_date, patch_id, op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), contract * 100 + target) AS held FROM x),
e AS (SELECT *, CASE WHEN NOT approved THEN 'review_status_not_approved' WHEN NOT sourced THEN 'missing_source_refs' WHEN target > 39 THEN 'target_not_found' WHEN l_partkey % 61 = 0 THEN 'expected_hash_mismatch' END AS error FROM h),
f AS (SELECT contract, min((effective_date, patch_id)) AS f FROM e WHERE error IS NOT NULL AND error <> 'review_status_not_approved' GROUP BY contract),
j AS (SELECT e.*, f.f, f.f IS NULL OR (effective_date, patch_id) <= f.f AS reached FROM e LEFT JOIN f USING (contract)),
s AS (SELECT *, CASE WHEN NOT reached THEN 'not_reached' WHEN error = 'review_status_not_approved' THEN 'skipped' WHEN error IS NOT NULL THEN 'failed' WHEN f IS NOT NULL THEN 'rolled_back' ELSE 'applied' END AS status FROM j)"""


@registry.query(f"WITH {OPS} SELECT contract, patch_id, op_no, target, CASE WHEN reached THEN error END AS error, status FROM s")
def apply_patches(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each operation: a failing patch stops its contract, and then none of its patches counts."""
    return patches.judge(operations(spark, sf), base_rows(spark, sf)).select("contract", "patch_id", "op_no", "target", "error", "status")


@registry.query(f"""WITH {OPS}, b AS (SELECT c.range AS contract, t.range AS target FROM range(1000) c, range(40) t), m AS (SELECT contract, target, arg_max(value, (effective_date, patch_id, op_no)) AS value, arg_max(patch_id, (effective_date, patch_id, op_no)) AS patch_id FROM s WHERE status = 'applied' GROUP BY ALL)
SELECT b.contract, b.target, coalesce(m.value, b.contract * 100 + b.target) AS value, m.patch_id FROM b LEFT JOIN m USING (contract, target)""")
def effective_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = base_rows(spark, sf)
    return patches.in_force(patches.judge(operations(spark, sf), base), base)


@registry.query(f"""WITH {OPS} SELECT contract, count(DISTINCT patch_id) AS patches, count(DISTINCT patch_id) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'failed') AS failed_ops, CASE WHEN any_value(f) IS NULL THEN 'success' ELSE 'failed' END AS status FROM s GROUP BY contract""")
def build_log(spark: SparkSession, sf: str) -> DataFrame:
    j = patches.judge(operations(spark, sf), base_rows(spark, sf))
    return j.groupBy("contract").agg(
        F.count_distinct("patch_id").alias("patches"), F.count_distinct(F.when(F.col("status") == "applied", F.col("patch_id"))).alias("applied"), F.count_if(F.col("status") == "failed").alias("failed_ops"),
        F.when(F.max("failed_patch").isNull(), "success").otherwise("failed").alias("status"),
    )


@registry.query("""SELECT p_partkey, '2022-01-01' AS effective, p_size, NULL AS error FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '2022-01-01' ELSE '2023-01-01' END, p_size + 1, CASE WHEN p_partkey % 10 = 0 THEN 'key_conflict' END FROM part WHERE p_partkey % 5 = 0""")
def supersede_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    base = p.select("p_partkey", F.lit("2022-01-01").alias("effective"), "p_size")
    newer = p.filter("p_partkey % 5 = 0").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "2022-01-01").otherwise("2023-01-01").alias("effective"), (F.col("p_size") + 1).alias("p_size"))
    return patches.supersede_strict(base, newer, ["p_partkey", "effective"])


@registry.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 1 AS new_quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01') a WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def rollforward_seed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in force at a date that no operation names yet become operations."""
    li = table(spark, sf, "lineitem")
    rows = li.filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast(li.schema["l_shipdate"].dataType)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    named = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.join(named, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + 1).alias("new_quantity"))


@registry.query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Section 3. ' || repeat(p_name || ' ', 9) WHEN 1 THEN p_name || ' ...' WHEN 2 THEN 'REVISED 2/3/24 Section 1 ' || repeat(p_name, 12) WHEN 3 THEN p_name ELSE repeat(p_name || '… ', 12) END AS t FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN contains(t, '...') OR contains(t, '…') THEN 'ellipsis' END, CASE WHEN regexp_matches(t, '(?i)revised\\s+\\d+/\\d+/\\d+') THEN 'revision_header' END, CASE WHEN length(t) < 80 THEN 'too_short' END, CASE WHEN NOT regexp_matches(t, '(?i)\\bsection\\s+\\d+') THEN 'missing_section_header' END) AS flags FROM d""")
def draft_flags(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    t = (
        F.when(k == 0, F.concat(F.lit("Section 3. "), F.repeat(F.concat(n, F.lit(" ")), 9))).when(k == 1, F.concat(n, F.lit(" ..."))).when(k == 2, F.concat(F.lit("REVISED 2/3/24 Section 1 "), F.repeat(n, 12)))
        .when(k == 3, n).otherwise(F.repeat(F.concat(n, F.lit("… ")), 12))
    )
    d = table(spark, sf, "part").select("p_partkey", t.alias("t"))
    flags = [F.when(F.col("t").contains("...") | F.col("t").contains("…"), "ellipsis"), F.when(F.col("t").rlike(r"(?i)revised\s+\d+/\d+/\d+"), "revision_header"), F.when(F.length("t") < 80, "too_short"), F.when(~F.col("t").rlike(r"(?i)\bsection\s+\d+"), "missing_section_header")]
    return d.select("p_partkey", F.concat_ws(",", *flags).alias("flags"))


@registry.query(r"""WITH d AS (SELECT p_partkey, '<b>' || p_name || '</b> ~~old ' || p_size || ' text~~ &amp; new' || chr(13) || chr(10) || 'rate[1]  &lt;' || p_size || '&gt;' AS t FROM part),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(t, '~~.*?~~', '', 'gs'), '<[^>]*>', '', 'g') AS t FROM d), u AS (SELECT p_partkey, replace(replace(replace(regexp_replace(t, '\[\d+\]', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM c)
SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g')) AS effective FROM u""")
def redline_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text in force of a marked-up draft: struck parts, tags and footnote marks go, entities are read, white space is made even."""
    raw = F.concat(F.lit("<b>"), "p_name", F.lit("</b> ~~old "), F.col("p_size").cast("string"), F.lit(" text~~ &amp; new\r\nrate[1]  &lt;"), F.col("p_size").cast("string"), F.lit("&gt;"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?s)~~.*?~~", ""), "<[^>]*>", ""), r"\[\d+\]", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return table(spark, sf, "part").select("p_partkey", T.canonical(bare).alias("effective"))


HTML = "'<p>x</p><table><tr><th> Name </th><th>Rate</th></tr><tr><td>' || p_name || '</td><td>$' || p_size || '</td></tr></table>' || CASE WHEN p_partkey % 3 = 0 THEN '<TABLE class=a><tr><td>Total  of' || chr(10) || p_brand || '</td></tr></TABLE>' ELSE '' END"
CELLS = f"""d AS (SELECT p_partkey, p_size, {HTML} AS html FROM part), t AS (SELECT p_partkey, p_size, unnest(l) AS tab, generate_subscripts(l, 1) AS n FROM (SELECT p_partkey, p_size, regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1) AS l FROM d)),
r AS (SELECT p_partkey, p_size, n, list_transform(regexp_extract_all(tab, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))) AS rows_ FROM t)"""


def html_tables(pages: DataFrame, html: str) -> DataFrame:
    """table_no and rows (array of arrays of trimmed cells) of every table of a page; nested tables aren't told apart."""
    all_of = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    found = pages.select(*[c for c in pages.columns if c != html], F.posexplode(all_of(html, r"(?is)<table[^>]*>(.*?)</table>")).alias("n", "_t"))
    rows = F.transform(all_of("_t", r"(?is)<tr[^>]*>(.*?)</tr>"), lambda r: F.transform(all_of(r, r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), clean))
    return found.withColumn("table_no", (F.col("n") + 1).cast("bigint")).withColumn("rows", rows).drop("n", "_t")


def content_hash(rows) -> object:
    """The first 16 hex digits of the SHA-256 of the lower-case cells as JSON with a blank behind each comma."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.lower(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, cell), ", "), F.lit("]"))
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, line), ", "), F.lit("]")), 256), 1, 16)


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables(table(spark, sf, "part").select("p_partkey", "p_size", F.expr(HTML.replace("chr(10)", "'\\n'")).alias("html")), "html")


@registry.query(f"""WITH {CELLS} SELECT p_partkey, CAST(n AS BIGINT) AS table_no, len(rows_) AS n_rows, array_to_string(list_transform(rows_, lambda r: array_to_string(r, '|')), chr(10)) AS cells,
substr(sha256('[' || array_to_string(list_transform(rows_, lambda r: '[' || array_to_string(list_transform(r, lambda c: '"' || lower(c) || '"'), ', ') || ']'), ', ') || ']'), 1, 16) AS content_hash FROM r""")
def html_table_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return t.select("p_partkey", "table_no", F.size("rows").cast("bigint").alias("n_rows"), cells.alias("cells"), content_hash(F.col("rows")).alias("content_hash"))


HASH = """substr(sha256('[' || array_to_string(list_transform(rows_, lambda r: '[' || array_to_string(list_transform(r, lambda c: '"' || lower(c) || '"'), ', ') || ']'), ', ') || ']'), 1, 16)"""


@registry.query(f"""WITH RECURSIVE {CELLS}, h AS (SELECT p_partkey, p_size, n, {HASH} AS h FROM r),
p AS (SELECT p_partkey // 40 AS contract, p_partkey * 10 + n AS place, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey, n) AS i, h, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 6 END AS article,
  lower(CASE WHEN p_partkey % 7 = 0 THEN p_name || ' of ' || p_type ELSE substr(p_name, 1, 4) END) AS heading FROM h JOIN part USING (p_partkey)),
reg AS (SELECT p_partkey // 40 AS contract, p_partkey * 10 + n AS place, 'reg_' || p_partkey || '_' || n AS id, CASE WHEN p_partkey % 4 = 0 THEN h ELSE 'x' || h END AS h, p_partkey % 5 AS article, [lower(p_name), lower(p_type) || ' rates'] AS path FROM h JOIN part USING (p_partkey) WHERE p_partkey % 4 <> 1),
q AS (SELECT p.*, (SELECT arg_max(id, place) FROM reg WHERE reg.contract = p.contract AND reg.h = p.h) AS rh,
  (SELECT list({{'id': id, 'hit': len(list_filter(path, lambda x: contains(p.heading, x) OR contains(x, p.heading))) > 0}} ORDER BY place) FROM reg WHERE reg.contract = p.contract AND reg.article = p.article) AS c FROM p),
w AS (SELECT contract, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS STRUCT(h VARCHAR, id VARCHAR)[]) AS made, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS table_id, CAST(NULL AS VARCHAR) AS how FROM (SELECT DISTINCT contract FROM q)
UNION ALL SELECT contract, i, list_append(used, id), CASE WHEN how = 'synthesized' THEN list_append(made, {{'h': h, 'id': id}}) ELSE made END, place, id, how FROM (
  SELECT *, coalesce(by_hash, by_heading, by_only, 'tbl_fallback_art' || coalesce(article, 0) || '_' || substr(h, 1, 8)) AS id, CASE WHEN by_hash IS NOT NULL THEN 'hash' WHEN by_heading IS NOT NULL THEN 'heading' WHEN by_only IS NOT NULL THEN 'only' ELSE 'synthesized' END AS how FROM (
    SELECT q.contract, q.i, q.place, q.h, q.article, used, made, coalesce(rh, list_filter(made, lambda x: x.h = q.h)[1].id) AS by_hash, list_filter(c, lambda x: NOT list_contains(used, x.id) AND x.hit)[1].id AS by_heading,
      CASE WHEN len(list_filter(c, lambda x: NOT list_contains(used, x.id))) = 1 THEN list_filter(c, lambda x: NOT list_contains(used, x.id))[1].id END AS by_only FROM w JOIN q ON q.contract = w.contract AND q.i = w.i + 1)))
SELECT contract, CAST(place AS BIGINT) AS place, table_id, how FROM w WHERE i > 0""")
def table_match(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of pages beside a registry, in the order of a contract: by the hash of their cells, by article and heading among the free ones, by the only free one, else made."""
    k, p = F.col("p_partkey"), table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    h = _tables(spark, sf).select("p_partkey", (k * 10 + F.col("table_no")).alias("place"), "table_no", content_hash(F.col("rows")).alias("hash")).join(p, "p_partkey").withColumn("contract", F.expr("p_partkey div 40"))
    heading = F.when(k % 7 == 0, F.concat_ws(" of ", "p_name", "p_type")).otherwise(F.substring("p_name", 1, 4))
    pages = h.select("contract", "place", "hash", F.when(k % 11 > 0, k % 6).alias("article"), heading.alias("heading"))
    held = h.filter(k % 4 != 1).select("contract", "place", F.concat_ws("_", F.lit("reg"), k, "table_no").alias("table_id"), F.when(k % 4 == 0, F.col("hash")).otherwise(F.concat(F.lit("x"), "hash")).alias("hash"), (k % 5).alias("article"), F.array("p_name", F.concat("p_type", F.lit(" rates"))).alias("path"))
    return tables.match_tables(pages, held)


_TABLE = """t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'APPENDIX ' || chr(65 + CAST(p_size % 4 AS INT)) || ' ' || p_name WHEN 1 THEN p_name || ' rates of pay' WHEN 2 THEN 'Table of Contents' ELSE p_name END AS heading,
CASE p_partkey % 3 WHEN 0 THEN 'Classification | Effective 1/1/22' || chr(10) || '$1 | $2 | $' || p_size WHEN 1 THEN '| Dental | Vacation |' ELSE '$3 | hourly rate' END AS md, p_size + 25 AS article FROM part), r AS (SELECT *, lower(heading || chr(10) || md) AS raw, length(md) - length(replace(md, '$', '')) AS dollars FROM t)"""


def _described(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    heading = (
        F.when(k % 5 == 0, F.concat(F.lit("APPENDIX "), F.chr(65 + F.col("p_size") % 4), F.lit(" "), "p_name")).when(k % 5 == 1, F.concat("p_name", F.lit(" rates of pay")))
        .when(k % 5 == 2, "Table of Contents").otherwise(F.col("p_name"))
    )
    md = F.when(k % 3 == 0, F.concat(F.lit("Classification | Effective 1/1/22\n$1 | $2 | $"), F.col("p_size").cast("string"))).when(k % 3 == 1, "| Dental | Vacation |").otherwise("$3 | hourly rate")
    return table(spark, sf, "part").select("p_partkey", heading.alias("heading"), md.alias("md"), (F.col("p_size") + 25).alias("article"))


@registry.query(f"""WITH {_TABLE} SELECT p_partkey, CASE WHEN contains(lower(heading), 'appendix') OR (article >= 50 AND ((contains(raw, 'classification') AND contains(raw, 'effective') AND dollars >= 3) OR contains(raw, 'rates of pay'))) THEN 'appendix' ELSE 'cba' END AS doc_type, contains(raw, 'table of contents') AS is_contents FROM r""")
def table_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of an appendix by their heading, or wage-like ones of articles from 50 on; tables of contents by what they are called."""
    t, none = _described(spark, sf), F.lit(None).cast("string")
    return t.select("p_partkey", tables.doc_type(F.col("heading"), F.col("md"), none, F.col("article")).alias("doc_type"), tables.is_contents(F.col("heading"), F.col("md"), none).alias("is_contents"))


@registry.query(f"""WITH {_TABLE} SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(raw, 'wage|rate|hourly|progression|journeyman|classification') THEN 'wages' END, CASE WHEN regexp_matches(raw, 'vacation|holiday|paid time') THEN 'vacation' END, CASE WHEN regexp_matches(raw, 'benefit|medical|dental|vision|insurance') THEN 'health_benefits' END) AS topics,
CASE WHEN p_partkey % 5 = 0 THEN 'Appendix ' || chr(65 + CAST((article - 25) % 4 AS INT)) WHEN (contains(raw, 'classification') AND contains(raw, 'effective') AND dollars >= 2) OR regexp_matches(raw, 'rate of pay|hourly rate|wage progression') THEN 'Appendix A Wage Table' ELSE 'Appendix' END AS cited FROM r""")
def table_topics(spark: SparkSession, sf: str) -> DataFrame:
    """What a table is about, and how it is cited as an appendix."""
    t, none = _described(spark, sf), F.lit(None).cast("string")
    return t.select("p_partkey", F.array_join(tables.topics(F.concat_ws("\n", "heading", "md")), ",").alias("topics"), tables.appendix_label(F.col("heading"), F.col("md"), none).alias("cited"))


#: Kinds of issues for a reviewer, with their severity, the least similarity that passes, and the most evidence kept.
LOW_SIMILARITY, MOST_EVIDENCE = 0.75, 100


@registry.query("""WITH i AS (SELECT 'unresolved_mapping' AS issue, 'high' AS severity, p_brand AS subject, p_partkey FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'low_similarity', 'medium', p_brand, p_partkey FROM part WHERE (p_size % 20) / 20.0 < 0.75
UNION ALL SELECT 'override_warning', 'medium', p_brand, p_partkey FROM part WHERE p_size = 77 UNION ALL SELECT 'unresolved_rows', 'medium', p_brand, p_partkey FROM part WHERE p_size % 9 = 4 UNION ALL SELECT 'canonical_conflicts', 'high', p_brand, p_partkey FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT 'canonical_ambiguities', 'medium', p_brand, p_partkey FROM part WHERE p_partkey % 17 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY issue, subject ORDER BY p_partkey) AS r FROM i) SELECT issue, severity, subject, count(*) AS n, string_agg(CASE WHEN r <= 100 THEN CAST(p_partkey AS VARCHAR) END, ',' ORDER BY p_partkey) AS evidence FROM r GROUP BY ALL""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """One row per kind of issue and subject that has any, with the first hundred of its evidence."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf, "part").select(F.col("p_brand").alias("subject"), "p_partkey", "p_size")
    kinds = [
        ("unresolved_mapping", "high", size % 10 == 0), ("low_similarity", "medium", (size % 20) / 20.0 < LOW_SIMILARITY), ("override_warning", "medium", size == 77),
        ("unresolved_rows", "medium", size % 9 == 4), ("canonical_conflicts", "high", k % 13 == 0), ("canonical_ambiguities", "medium", k % 17 == 0),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("issue"), F.lit(s).alias("severity"))) for i, s, c in kinds]))
    i = p.select("subject", "p_partkey", F.explode(found).alias("k")).select("subject", "p_partkey", "k.*")
    first = windows.top_per_key(i, ["issue", "subject"], [F.col("p_partkey")], MOST_EVIDENCE)
    evidence = first.groupBy("issue", "subject").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("evidence"))
    return i.groupBy("issue", "severity", "subject").agg(F.count(F.lit(1)).alias("n")).join(evidence, ["issue", "subject"])


@registry.query("""SELECT 'wage_rows_exist' AS check_id, 'required' AS severity, count(*) > 0 AS passed, count(*) AS metric FROM part UNION ALL SELECT 'row_ids_unique', 'required', count(*) = count(DISTINCT p_partkey), count(*) - count(DISTINCT p_partkey) FROM part
UNION ALL SELECT 'sizes_in_scope', 'advisory', count(*) FILTER (p_size > 45) = 0, count(*) FILTER (p_size > 45) FROM part UNION ALL SELECT 'lines_have_rows', 'required', count(*) = 0, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'coverage', 'advisory', count(DISTINCT l_partkey) >= 0.5 * (SELECT count(*) FROM part), count(DISTINCT l_partkey) FROM lineitem""")
def pack_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """One row per check: existence, unique ids, scope, references and coverage; a pack is accepted if no required one fails."""
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    s = p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("ids"), F.count_if(F.col("p_size") > 45).alias("big"))
    lost = li.join(p, li.l_partkey == p.p_partkey, "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    used = li.agg(F.count_distinct("l_partkey").alias("used"))
    one = s.crossJoin(lost).crossJoin(used)  # three rows of one
    checks = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(v).alias("severity"), ok.alias("passed"), m.cast("bigint").alias("metric")) for i, v, ok, m in (
        ("wage_rows_exist", "required", F.col("n") > 0, F.col("n")), ("row_ids_unique", "required", F.col("n") == F.col("ids"), F.col("n") - F.col("ids")), ("sizes_in_scope", "advisory", F.col("big") == 0, F.col("big")),
        ("lines_have_rows", "required", F.col("lost") == 0, F.col("lost")), ("coverage", "advisory", F.col("used") >= 0.5 * F.col("n"), F.col("used")))])
    return one.select(F.explode(checks).alias("c")).select("c.*")
