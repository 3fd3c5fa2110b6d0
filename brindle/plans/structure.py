"""Contracts as numbered lines, made from parts: headings, offsets, pages, chunks, outlines and related sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import structure as S
from ..operators import windows
from ..sources.tables import table
from .registry import Registry

registry = Registry()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """A contract per brand and line status of sizes: articles, sections, lettered and plain lines."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    step = F.floor(k / 25) % 40
    text = (
        F.when(step % 8 == 0, F.concat(F.lit("ARTICLE "), (F.floor(step / 8) % 5 + 1).cast("string"), F.lit(" - "), "p_name"))
        .when(step % 2 == 1, F.concat(F.lit("Section "), (step % 11).cast("string"), F.lit(". "), "p_name", F.lit(". Staff of "), "p_type", F.lit(" shall be paid; see Section "), (step % 7).cast("string")))
        .when(step % 4 == 2, F.concat(F.lit("("), F.substring(F.lit("abcdefg"), (step % 7 + 1).cast("int"), F.lit(1)), F.lit(") "), "p_name")).otherwise(F.concat("p_name", F.lit("  of\t"), "p_type", F.lit(" goods; more. And more words follow here, so that it is long: "), "p_brand", F.lit(" "), "p_name"))
    )
    return p.select((k % 25).alias("contract"), k.alias("line_no"), text.alias("line"), "p_name")


LINES = """s AS (SELECT p_partkey % 25 AS contract, p_partkey AS line_no, CAST(floor(p_partkey / 25) AS BIGINT) % 40 AS st, p_name, p_type, p_brand FROM part),
li AS (SELECT contract, line_no, p_name, CASE WHEN st % 8 = 0 THEN 'ARTICLE ' || (st // 8 % 5 + 1) || ' - ' || p_name WHEN st % 2 = 1 THEN 'Section ' || (st % 11) || '. ' || p_name || '. Staff of ' || p_type || ' shall be paid; see Section ' || (st % 7)
WHEN st % 4 = 2 THEN '(' || substr('abcdefg', CAST(st % 7 + 1 AS INT), 1) || ') ' || p_name ELSE p_name || '  of' || chr(9) || p_type || ' goods; more. And more words follow here, so that it is long: ' || p_brand || ' ' || p_name END AS line FROM s)"""
HEADED = LINES + r""", m AS (SELECT *, nullif(regexp_extract(line, '(?i)^(?:#+\s*)?article\s+([0-9]+[a-z]?)\s*[:\-.]?\s*(.*)$', 1), '') AS a, regexp_extract(line, '(?i)^(?:#+\s*)?article\s+([0-9]+[a-z]?)\s*[:\-.]?\s*(.*)$', 2) AS ati,
nullif(regexp_extract(line, '(?i)^(?:#+\s*)?(?:section|sec\.?)\s+([0-9]+(?:\.[0-9a-z]+)?)\s*[:\-.]?\s*(.*)$', 1), '') AS se, regexp_extract(line, '(?i)^(?:#+\s*)?(?:section|sec\.?)\s+([0-9]+(?:\.[0-9a-z]+)?)\s*[:\-.]?\s*(.*)$', 2) AS sti FROM li),
p AS (SELECT *, count(a) OVER w AS part_no, last_value(a IGNORE NULLS) OVER w AS article, last_value(CASE WHEN a IS NOT NULL THEN ati END IGNORE NULLS) OVER w AS article_title FROM m WINDOW w AS (PARTITION BY contract ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, last_value(se IGNORE NULLS) OVER w AS section, last_value(CASE WHEN se IS NOT NULL THEN sti END IGNORE NULLS) OVER w AS section_title FROM p WINDOW w AS (PARTITION BY contract, part_no ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_headings(lines(spark, sf), "contract", "line_no", "line")


@registry.query(f"WITH {HEADED} SELECT contract, line_no, article, section FROM h")
def heading_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return _headed(spark, sf).select("contract", "line_no", "article", "section")


@registry.query(f"WITH {LINES} SELECT contract, line_no, CAST(sum(length(line) + 2) OVER w - length(line) - 2 AS BIGINT) AS start, CAST(sum(length(line) + 2) OVER w AS BIGINT) AS \"end\" FROM li WINDOW w AS (PARTITION BY contract ORDER BY line_no ROWS UNBOUNDED PRECEDING)")
def running_offset(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_offsets(lines(spark, sf), "contract", "line_no", "line", 2).select("contract", "line_no", "start", "end")


@registry.query(f"""WITH {HEADED}, o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY contract ORDER BY line_no ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS start FROM h), t AS (SELECT contract, sum(length(line) + 1) AS total FROM li GROUP BY contract)
SELECT o.contract, article, section, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY o.contract ORDER BY line_no), total) AS BIGINT) AS "end" FROM o JOIN t USING (contract) WHERE a IS NOT NULL OR se IS NOT NULL""")
def section_end(spark: SparkSession, sf: str) -> DataFrame:
    """A heading's stretch ends where the next one begins, the last one with the text."""
    o = S.with_offsets(_headed(spark, sf), "contract", "line_no", "line", 1)
    o = o.withColumn("total", F.max("end").over(Window.partitionBy("contract"))).filter("is_article OR is_section")
    until = F.coalesce(F.lead("start").over(Window.partitionBy("contract").orderBy("line_no")), F.col("total"))
    return o.select("contract", "article", "section", "start", until.alias("end"))


@registry.query(f"""WITH {LINES}, o AS (SELECT contract, line_no, sum(length(line) + 2) OVER (PARTITION BY contract ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS e FROM li), q AS (SELECT contract, line_no AS q_id, (line_no * 37) % 6000 AS "at" FROM li)
SELECT q.contract, q_id, "at", coalesce((SELECT min(line_no) FROM o WHERE o.contract = q.contract AND o.e >= "at"), (SELECT max(line_no) FROM o WHERE o.contract = q.contract)) AS page FROM q""")
def page_of_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in the place of pages; offsets behind the end are on the last one."""
    pages = S.with_offsets(lines(spark, sf), "contract", "line_no", "line", 2).select("contract", "end", F.col("line_no").alias("page"))
    offsets = lines(spark, sf).select("contract", F.col("line_no").alias("q_id"), (F.col("line_no") * 37 % 6000).alias("at"))
    return S.page_at(offsets, pages, "contract", "at", "end", "page")


CHUNKED = HEADED + r""", l AS (SELECT *, nullif(regexp_extract(line, '^\(?([a-z])[.)]\s+(.*)$', 1), '') AS letter FROM h WHERE article IS NOT NULL),
n AS (SELECT *, count(letter) OVER (PARTITION BY contract, article, section) >= 2 AND section IS NOT NULL AS lettered, bool_or(section IS NOT NULL) OVER (PARTITION BY contract, article) AS has, last_value(letter IGNORE NULLS) OVER (PARTITION BY contract, article, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS lp FROM l),
k AS (SELECT *, CASE WHEN lettered THEN lp END AS part FROM n WHERE (NOT has OR section IS NOT NULL) AND (NOT lettered OR lp IS NOT NULL)),
c AS (SELECT contract, article, section, part, min(line_no) AS first, min_by(article_title, line_no) AS article_title, min_by(section_title, line_no) AS section_title, string_agg(line, chr(10) ORDER BY line_no) AS content FROM k GROUP BY ALL)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunks(lines(spark, sf), "contract", "line_no", "line")


@registry.query(f"""WITH {CHUNKED} SELECT contract, 'art' || article || CASE WHEN section IS NOT NULL THEN '_sec' || section ELSE '' END || CASE WHEN part IS NOT NULL THEN '_sub_' || part ELSE '' END AS chunk_id,
'Article ' || article || CASE WHEN section IS NOT NULL THEN ', Section ' || section ELSE '' END || CASE WHEN part IS NOT NULL THEN ', Subsection ' || part ELSE '' END AS citation,
concat_ws(' > ', 'Article ' || article || ' (' || article_title || ')', CASE WHEN section IS NOT NULL THEN 'Section ' || section || CASE WHEN section_title <> '' THEN ' (' || section_title || ')' ELSE '' END END, CASE WHEN part IS NOT NULL THEN 'Subsection ' || part END) AS context,
length(content) AS n_chars, sha256(content) AS content_sha256 FROM c""")
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    a, s, p = F.col("article"), F.col("section"), F.col("part")
    return _chunks(spark, sf).select(
        "contract", S.chunk_id(a, s, p).alias("chunk_id"), S.citation(a, s, p).alias("citation"), S.parent_context(a, F.col("article_title"), s, F.col("section_title"), p).alias("context"),
        F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"),
    )


@registry.query(f"""WITH {HEADED}, d AS (SELECT contract, line_no, article || '.' || coalesce(section, '0') AS base FROM h WHERE article IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY contract, base ORDER BY line_no) - 1 AS n FROM d)
SELECT contract, line_no, base || CASE WHEN n > 0 THEN '__dup' || n ELSE '' END AS chunk_id FROM r""")
def chunk_id_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a contract's lines by article and section; a contract bounds how often an id repeats."""
    d = _headed(spark, sf).filter("article IS NOT NULL").withColumn("base", F.concat("article", F.lit("."), F.coalesce("section", F.lit("0"))))
    n = F.row_number().over(Window.partitionBy("contract", "base").orderBy("line_no")) - 1
    return d.select("contract", "line_no", F.concat("base", F.when(n > 0, F.concat(F.lit("__dup"), n.cast("string"))).otherwise("")).alias("chunk_id"))


@registry.query(f"""WITH {HEADED}, o AS (SELECT contract, article, section, min_by(coalesce(section_title, article_title), line_no) AS label FROM h WHERE article IS NOT NULL GROUP BY ALL)
SELECT contract, article, section, label, row_number() OVER (PARTITION BY contract ORDER BY try_cast(article AS INT) IS NULL, try_cast(article AS INT), article, section IS NOT NULL, try_cast(section AS INT), section) AS place FROM o""")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct articles and sections with their first label, numbers before texts."""
    o = _headed(spark, sf).filter("article IS NOT NULL").groupBy("contract", "article", "section").agg(F.min_by(F.coalesce("section_title", "article_title"), "line_no").alias("label"))
    number = lambda c: F.try_cast(F.col(c), "int") if hasattr(F, "try_cast") else F.expr(f"try_cast({c} AS int)")
    order = [number("article").isNull(), number("article"), F.col("article"), F.col("section").isNotNull(), number("section"), F.col("section")]
    return o.withColumn("place", F.row_number().over(Window.partitionBy("contract").orderBy(*order)).cast("bigint")).select("contract", "article", "section", "label", "place")


@registry.query(f"WITH {HEADED} SELECT contract, article, section, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS text_sha256 FROM h WHERE article = '3' GROUP BY ALL")
def section_read(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each section of an article, in order, as one text."""
    h = _headed(spark, sf).filter("article = '3'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return h.groupBy("contract", "article", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.sha2(text, 256).alias("text_sha256"))


@registry.query(f"WITH {HEADED} SELECT contract, article, count(DISTINCT section) AS sections, count(*) AS n_lines, sum(CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END)::BIGINT AS with_digits FROM h WHERE article IS NOT NULL GROUP BY ALL")
def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _headed(spark, sf).filter("article IS NOT NULL").groupBy("contract", "article").agg(F.count_distinct("section").alias("sections"), F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").rlike("[0-9]")).alias("with_digits"))


@registry.query(f"""WITH {HEADED}, t AS (SELECT contract, article, section, line_no, length(line) AS n FROM h WHERE article IS NOT NULL AND section IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY contract, article, section ORDER BY n DESC, line_no) AS r FROM t) SELECT contract, article, section, line_no, n FROM r WHERE r = 1""")
def candidate_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The longest text of each article and section, the first on ties."""
    t = _headed(spark, sf).filter("article IS NOT NULL AND section IS NOT NULL").select("contract", "article", "section", "line_no", F.length("line").cast("bigint").alias("n"))
    return windows.top_per_key(t, ["contract", "article", "section"], [F.desc("n"), F.col("line_no")])


@registry.query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM documents), s AS (SELECT doc_id, regexp_extract(x || ' ', '^(.*?(?:[.!?][ ]|$))', 1) AS y, x FROM d), f AS (SELECT doc_id, CASE WHEN y = '' THEN x ELSE trim(y) END AS f FROM s),
c AS (SELECT doc_id, f, rtrim(substr(f, 1, 180)) AS c FROM f) SELECT doc_id, CASE WHEN length(f) <= 180 THEN f ELSE CASE WHEN contains(c, ' ') THEN regexp_replace(c, ' [^ ]*$', '') ELSE c END || '...' END AS summary FROM c""")
def first_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.first_sentence(F.col("text")).alias("summary"))


@registry.query(f"""WITH {LINES}, t AS (SELECT contract, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS x FROM li), w AS (SELECT *, substr(x, 1, 81) AS w FROM t),
p AS (SELECT *, CASE WHEN contains(w, '. ') THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END AS p1, CASE WHEN contains(w, '; ') THEN length(w) - strpos(reverse(w), ' ;') - 1 ELSE -1 END AS p2, CASE WHEN contains(w, ' ') THEN length(w) - strpos(reverse(w), ' ') ELSE -1 END AS p3 FROM w)
SELECT contract, line_no, CASE WHEN length(x) <= 80 THEN x WHEN p1 >= 30 THEN rtrim(substr(w, 1, p1), ' .;') || '…' WHEN p2 >= 30 THEN rtrim(substr(w, 1, p2), ' .;') || '…' WHEN p3 >= 30 THEN rtrim(substr(w, 1, p3), ' ,;:') || '…' ELSE rtrim(substr(x, 1, 80)) || '…' END AS label FROM p""")
def section_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("contract", "line_no", S.short_label(F.col("line")).alias("label"))


@registry.query(r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'file=' || replace(p_name, ' ', '+') || '.pdf#page=' || p_size WHEN 1 THEN 'file=' || p_brand ELSE p_name END AS token FROM part)
SELECT p_partkey, nullif(trim(replace(regexp_extract(token, '^file=([^#]+)', 1), '+', ' ')), '') AS file, try_cast(nullif(regexp_extract(token, '#page=(\d+)', 1), '') AS INT) AS page FROM r""")
def source_ref_parse(spark: SparkSession, sf: str) -> DataFrame:
    """File and page of a provenance token; blanks of file names are plus signs."""
    k = F.col("p_partkey") % 3
    token = F.when(k == 0, F.concat(F.lit("file="), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit(".pdf#page="), F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("file="), "p_brand")).otherwise(F.col("p_name"))
    p = table(spark, sf, "part").select("p_partkey", token.alias("token"))
    file = F.trim(F.replace(F.regexp_extract("token", "^file=([^#]+)", 1), F.lit("+"), F.lit(" ")))
    return p.select("p_partkey", F.nullif(file, F.lit("")).alias("file"), F.nullif(F.regexp_extract("token", r"#page=(\d+)", 1), F.lit("")).cast("int").alias("page"))


SECTIONS = HEADED + r""", x AS (SELECT contract, article, CAST(section AS INT) AS section, list_transform(regexp_extract_all(line, 'see Section (\d+)', 1), lambda v: CAST(v AS INT)) AS refs FROM h WHERE article IS NOT NULL AND section IS NOT NULL),
sec AS (SELECT DISTINCT contract, article, section FROM x), hit AS (SELECT * FROM x WHERE section IN (1, 2, 6)), b AS (SELECT contract, article, list(DISTINCT section) AS base, list_distinct(flatten(list(refs))) AS refs FROM hit GROUP BY ALL)"""


@registry.query(f"""WITH {SECTIONS}, d AS (SELECT sec.contract, sec.article, section, list_contains(refs, section) AS named, list_min(list_transform(base, lambda y: abs(section - y))) AS dist FROM sec JOIN b ON b.contract = sec.contract AND b.article = sec.article WHERE NOT list_contains(base, section)),
k AS (SELECT *, CASE WHEN named THEN 0 WHEN dist <= 1 THEN 1 ELSE 2 END AS kind FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY contract, article ORDER BY kind, CASE WHEN kind = 0 THEN 0 ELSE dist END, section) AS place FROM k)
SELECT contract, article, section, kind, place FROM r WHERE place <= 2""")
def related_sections(spark: SparkSession, sf: str) -> DataFrame:
    refs = F.transform(F.regexp_extract_all("line", F.lit(r"see Section (\d+)"), F.lit(1)), lambda v: v.cast("int"))
    x = _headed(spark, sf).filter("article IS NOT NULL AND section IS NOT NULL").select("contract", "article", F.col("section").cast("int").alias("section"), refs.alias("refs"))
    return S.related_sections(x.filter(F.col("section").isin(1, 2, 6)), x.select("contract", "article", "section").distinct(), "contract")


@registry.query(f"""WITH {SECTIONS}, o AS (SELECT contract, article, section, row_number() OVER (PARTITION BY contract ORDER BY (CAST(article AS INT) * 7 + section * 3) % 11, article, section) AS r FROM sec), top AS (SELECT * FROM o WHERE r <= 5),
c AS (SELECT contract, article, count(*) AS n, min(r) AS first FROM top GROUP BY ALL), pick AS (SELECT contract, article FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY article = '3' DESC, n DESC, first) AS q FROM c WHERE article = '3' OR n >= 2) WHERE q = 1),
add_ AS (SELECT sec.*, row_number() OVER (PARTITION BY sec.contract ORDER BY section) AS place FROM sec JOIN pick USING (contract, article) WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.contract = sec.contract AND top.article = sec.article AND top.section = sec.section))
SELECT contract, article, section, place FROM add_ WHERE place <= 10""")
def full_article_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """The preferred article if it is among the first five, else one with two or more of them: its missing sections, fifteen rows in all."""
    x = _headed(spark, sf).filter("article IS NOT NULL AND section IS NOT NULL").select("contract", "article", F.col("section").cast("int").alias("section")).distinct()
    order = [(F.col("article").cast("int") * 7 + F.col("section") * 3) % 11, F.col("article"), F.col("section")]
    first = windows.top_per_key(x, ["contract"], order, 5, "r")
    counted = first.groupBy("contract", "article").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first")).filter("article = '3' OR n >= 2")
    pick = windows.top_per_key(counted, ["contract"], [(F.col("article") == "3").desc(), F.desc("n"), F.col("first")]).select("contract", "article")
    missing = x.join(pick, ["contract", "article"]).join(first.select("contract", "article", "section"), ["contract", "article", "section"], "left_anti")
    return windows.top_per_key(missing, ["contract"], [F.col("section")], 10, "place").withColumn("place", F.col("place").cast("bigint"))


@registry.query(f"""WITH {SECTIONS}, a(article) AS (VALUES ('1'), ('2'), ('9')), hits AS (SELECT DISTINCT contract, article FROM hit), need AS (SELECT DISTINCT sec.contract, a.article FROM sec, a WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.contract = sec.contract AND hits.article = a.article AND a.article = '2')),
sc AS (SELECT sec.*, round(0.3::DOUBLE + (section * 7 % 10) / 20.0, 6) AS overlap FROM sec JOIN need USING (contract, article)), r AS (SELECT *, row_number() OVER (PARTITION BY contract, article ORDER BY overlap DESC, section) AS r FROM sc WHERE overlap >= 0.42), t AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY overlap DESC, article) AS place FROM r WHERE r = 1)
SELECT contract, article, section, overlap, place FROM t WHERE place <= 3""")
def topic_seed_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """For anchor articles that the hits lack: the best section of each, of an overlap of 0.42 or more, three a contract."""
    refs = F.array().cast("array<int>")
    x = _headed(spark, sf).filter("article IS NOT NULL AND section IS NOT NULL").select("contract", "article", F.col("section").cast("int").alias("section"), refs.alias("refs"))
    sections = x.select("contract", "article", "section").distinct()
    had = sections.filter(F.col("section").isin(1, 2, 6) & (F.col("article") == "2")).select("contract", "article").distinct()
    lacking = sections.filter(F.col("article").isin("1", "2", "9")).join(had, ["contract", "article"], "left_anti")
    scored = lacking.withColumn("overlap", F.round(0.3 + (F.col("section") * 7 % 10) / 20.0, 6)).filter("overlap >= 0.42")
    best = windows.top_per_key(scored, ["contract", "article"], [F.desc("overlap"), F.col("section")])
    return windows.top_per_key(best, ["contract"], [F.desc("overlap"), F.col("article")], 3, "place").withColumn("place", F.col("place").cast("bigint"))


@registry.query(f"""WITH {SECTIONS} SELECT contract, article, section, row_number() OVER (PARTITION BY contract ORDER BY article NOT IN ('2', '4'), -(0.4::DOUBLE + section / 100.0 + CASE WHEN section % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END), section, article) AS place FROM sec""")
def article_prioritize(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the topic's articles first, then by score with bonuses, then by section."""
    x = _headed(spark, sf).filter("article IS NOT NULL AND section IS NOT NULL").select("contract", "article", F.col("section").cast("int").alias("section")).distinct()
    score = 0.4 + F.col("section") / 100.0 + F.when(F.col("section") % 2 == 0, 0.05).otherwise(0.0)
    w = Window.partitionBy("contract").orderBy(~F.col("article").isin("2", "4"), -score, "section", "article")
    return x.withColumn("place", F.row_number().over(w).cast("bigint"))


@registry.query(f"""WITH {LINES}, d AS (SELECT contract, line_no, line, contract % 3 = 0 AS letter, (length(line) - length(replace(lower(line), 'e', ''))) AS hits FROM li), a AS (SELECT contract, line_no % 10 AS article, count(*) FILTER (letter AND line_no % 2 = 0) AS by_type, sum(CASE WHEN contains(line, 'Staff') THEN 1 ELSE 0 END) AS by_word FROM d GROUP BY ALL),
ty AS (SELECT *, sum(by_type) OVER (PARTITION BY contract) > 0 AS typed FROM a), n AS (SELECT contract, article, CASE WHEN typed THEN by_type ELSE by_word END AS n FROM ty) SELECT contract, article, CAST(n AS BIGINT) AS n, row_number() OVER (PARTITION BY contract ORDER BY n DESC, article) AS place FROM n WHERE n > 0""")
def letter_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with side letters by type; only where a contract has none, by words of the text."""
    letter = (F.col("contract") % 3 == 0) & (F.col("line_no") % 2 == 0)
    a = lines(spark, sf).groupBy("contract", (F.col("line_no") % 10).alias("article")).agg(F.count_if(letter).alias("t"), F.count_if(F.col("line").contains("Staff")).alias("w"))
    typed = F.sum("t").over(Window.partitionBy("contract")) > 0
    n = a.withColumn("n", F.when(typed, F.col("t")).otherwise(F.col("w"))).filter("n > 0")
    return n.select("contract", "article", "n", F.row_number().over(Window.partitionBy("contract").orderBy(F.desc("n"), "article")).cast("bigint").alias("place"))


@registry.query()
def long_section_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut as long sections are; the tests pack the paragraphs one by one."""
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.explode(S.segments(F.col("text"))).alias("s"))
    return d.select("doc_id", "s.segment", "s.citation", F.length("s.text").cast("bigint").alias("n_chars"), F.sha2("s.text", 256).alias("text_sha256"))


@registry.query(r"""SELECT p_brand, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'LOU ' || (p_partkey % 20) END AS own, last_value(CASE WHEN p_partkey % 9 = 0 THEN 'lou' || (p_partkey % 20) END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS letter FROM part""")
def letters_of_understanding(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of letters of understanding, and the letter that each line behind them belongs to."""
    k = F.col("p_partkey")
    line = F.when(k % 9 == 0, F.concat(F.lit("LETTER OF UNDERSTANDING "), (k % 20).cast("string"))).otherwise(F.col("p_name"))
    number = F.regexp_extract(line, r"(?i)^(?:#+\s*)?letter of understanding\s+#?(\d+)", 1)
    found = table(spark, sf, "part").select("p_brand", k, F.nullif(number, F.lit("")).alias("n"))
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("p_brand", "p_partkey", F.concat(F.lit("LOU "), "n").alias("own"), F.concat(F.lit("lou"), F.last("n", True).over(w)).alias("letter"))
