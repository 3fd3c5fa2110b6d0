"""Redaction, safety, parse quality, chunking and grounding over documents, pages and conversations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .registry import Registry

registry = Registry()


@registry.query(r"""SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '([A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{0,62})@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***@\3', 'g')) AS redacted_sha256,
CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]{1,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS n_emails FROM documents""")
def email_redact(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    pattern = r"([A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{0,62})@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.regexp_replace(t, pattern, "$1***@$3"), 256).alias("redacted_sha256"), F.regexp_count(t, F.lit(pattern)).cast("bigint").alias("n_emails"))


def redaction_steps(keys: str) -> str:
    """t1 to t10, from t0 (keys, raw, x, classes): the text after each class of personal data. What the phone pattern looks behind at is kept as a group.

    Two passes over phones: the character that parts two numbers can only belong to one match.
    """
    steps = []
    for i, (name, pattern, mask) in enumerate(T.PERSONAL):
        to = re.sub(r"\$(\d)", r"\\\1", mask)
        if name == "phone":
            pattern, to = r"(^|[^\d])" + pattern.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)") + r"($|[^\d])", r"\1(***) ***-\4\5"
        once = f"regexp_replace(x, '{pattern.removeprefix('(?i)')}', '{to}', '{'gi' if pattern.startswith('(?i)') else 'g'}')"
        steps.append(f"u{i + 1} AS (SELECT *, {once} AS y FROM t{i})")
        again = once.replace("(x,", "(y,") if name == "phone" else "y"
        steps.append(f"t{i + 1} AS (SELECT {keys}, raw, {again} AS x, CASE WHEN y <> x THEN list_append(classes, '{name}') ELSE classes END AS classes FROM u{i + 1})")
    return ", ".join(steps)


def _redaction_sql() -> str:
    return "t0 AS (SELECT doc_id, text AS raw, coalesce(text, '') AS x, CAST([] AS VARCHAR[]) AS classes FROM documents), " + redaction_steps("doc_id")


@registry.query(f"WITH {_redaction_sql()} SELECT doc_id, x AS redacted, array_to_string(list_sort(classes), ',') AS classes FROM t10")
def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    """All ten classes in their order."""
    d = table(spark, sf, "documents").select("doc_id", T.redaction(F.col("text")).alias("r"))
    return d.select("doc_id", F.col("r.text").alias("redacted"), F.array_join("r.classes", ",").alias("classes"))


_INJECTION_SQL = "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({{c}}, '')), '{p}') THEN '{label}' END" for label, p in T.INJECTION).replace("{0,40}", "{{0,40}}") + "], lambda x: x IS NOT NULL))), ',')"


@registry.query(f"SELECT doc_id, {_INJECTION_SQL.format(c='text')} AS labels FROM documents")
def injection_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.injection_labels(F.col("text")), ",").alias("labels"))


@registry.query(f"""WITH {_redaction_sql()}, s AS (SELECT doc_id, list_filter(string_split({_INJECTION_SQL.format(c='raw')}, ','), lambda x: x <> '') AS labels, classes FROM t10)
SELECT doc_id, CASE WHEN len(labels) > 0 THEN 'blocked_prompt_injection' WHEN len(classes) > 0 THEN 'flagged_sensitive_data' ELSE 'clear' END AS status, len(labels) = 0 AS member_visible,
array_to_string(list_sort(list_distinct(list_concat(labels, list_transform(classes, lambda c: 'sensitive_' || c)))), ',') AS reasons FROM s""")
def safety_status(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.injection_labels(F.col("text")).alias("labels"), T.redacted_classes(F.col("text")).alias("classes"))
    reasons = F.array_sort(F.array_union("labels", F.transform("classes", lambda c: F.concat(F.lit("sensitive_"), c))))
    return d.select("doc_id", T.safety_status(F.col("labels"), F.col("classes")).alias("status"), (F.size("labels") == 0).alias("member_visible"), F.array_join(reasons, ",").alias("reasons"))


@registry.query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@registry.query(r"""SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<table')) AS BIGINT) AS tables, CAST(len(regexp_extract_all(lower(html), '<li')) AS BIGINT) AS items,
CAST(len(regexp_extract_all(lower(html), '<a ')) AS BIGINT) AS links FROM pages""")
def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda p: F.regexp_count(F.lower("html"), F.lit(p)).cast("bigint")
    return table(spark, sf, "pages").select("page_id", n("<table").alias("tables"), n("<li").alias("items"), n("<a ").alias("links"))


@registry.query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '')) AS content_hash FROM documents""")
def canonical_text_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.canonical(F.col("text")), 256).alias("content_hash"))


@registry.query("""SELECT doc_id, CAST(i // 680 AS BIGINT) AS chunk, sha256(substr(text, CAST(i + 1 AS BIGINT), 800)) AS piece_sha256 FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 680)) AS i FROM documents WHERE length(text) > 0)""")
def fixed_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pieces = table(spark, sf, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("chunk", "piece"))
    return pieces.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.sha2("piece", 256).alias("piece_sha256"))


@registry.query()
def paragraph_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Lines packed into chunks by a fold; order-dependent, so there is no SQL beside it."""
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(T.pack_paragraphs(F.col("text"), breaks=r"\n")).alias("chunk", "piece"))
    return chunks.select("doc_id", "chunk", F.length("piece").alias("n_chars"), "piece")


@registry.query("""WITH p AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS full_, string_split(text, chr(10)) AS pages FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(pages) AS n, len(full_) AS filled, length(trim(text)) AS chars FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS pages, round((n - filled) / CAST(n AS DOUBLE), 6) AS empty_ratio, round(chars / CAST(n AS DOUBLE), 6) AS chars_per_page,
CASE WHEN chars = 0 THEN 'no_text_after_parse' WHEN n >= 3 AND (n - filled) / CAST(n AS DOUBLE) >= 0.4 THEN 'sparse_page_coverage' WHEN n >= 3 AND chars / CAST(n AS DOUBLE) < 200 THEN 'low_text_density' WHEN chars / CAST(n AS DOUBLE) < 500 THEN 'low_text_density_warning' ELSE 'acceptable_parse' END AS reason,
CASE WHEN chars = 0 THEN 'high' WHEN chars / CAST(n AS DOUBLE) < 200 OR (n - filled) / CAST(n AS DOUBLE) >= 0.4 THEN 'medium' ELSE 'low' END AS scan_likelihood FROM m""")
def parse_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Density checks with lines in the place of pages."""
    pages = F.split("text", "\n")
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.size(pages).alias("n"), F.size(F.filter(pages, lambda x: F.trim(x) != "")).alias("filled"), F.length(F.trim("text")).alias("chars"))
    empty, density = (F.col("n") - F.col("filled")) / F.col("n"), F.col("chars") / F.col("n")
    reason = (
        F.when(F.col("chars") == 0, "no_text_after_parse").when((F.col("n") >= 3) & (empty >= 0.4), "sparse_page_coverage").when((F.col("n") >= 3) & (density < 200), "low_text_density")
        .when(density < 500, "low_text_density_warning").otherwise("acceptable_parse")
    )
    scan = F.when(F.col("chars") == 0, "high").when((density < 200) | (empty >= 0.4), "medium").otherwise("low")
    return d.select("doc_id", F.col("n").cast("bigint").alias("pages"), F.round(empty, 6).alias("empty_ratio"), F.round(density, 6).alias("chars_per_page"), reason.alias("reason"), scan.alias("scan_likelihood"))


@registry.query(f"""SELECT conv_id, turn, role, {_INJECTION_SQL.format(c='text')} AS reasons, len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda x: x <> '')) > 4000 AS over_limit FROM conversations""")
def prompt_scan(spark: SparkSession, sf: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", "[ \t\n]+"), lambda x: x != ""))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_join(T.injection_labels(F.col("text")), ",").alias("reasons"), (words > 4000).alias("over_limit"))


_SCANS = [("prompt_injection", label, re.compile(p, re.IGNORECASE)) for label, p in T.INJECTION] + [("sensitive_data", name, re.compile(p)) for name, p, _ in T.PERSONAL]


def _compact(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def review_findings(text: str | None, most: int = 12) -> list[tuple[str, str, str, str]]:
    """Category, label, match and the match with 80 characters on either side, in the order of the patterns and of their matches.

    A finding counts once by category, label and match; the first gives the context.
    """
    found: dict[tuple[str, str, str], str] = {}
    for category, label, pattern in _SCANS:
        for m in pattern.finditer(text or ""):
            key = (category, label, _compact(m.group(0)))
            if key not in found:
                found[key] = _compact(text[max(0, m.start() - 80) : m.end() + 80])
                if len(found) == most:
                    return [(*k, c) for k, c in found.items()]
    return [(*k, c) for k, c in found.items()]


@registry.query()
def safety_findings(spark: SparkSession, sf: str) -> DataFrame:
    """All findings of injection and personal data, numbered, twelve at most a document; SQL's regexes give no positions and don't look behind."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *f) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for n, f in enumerate(review_findings(t.as_py()), 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()] * 4, strict=True)], names=["doc_id", "finding", "category", "label", "match_preview", "context"])

    return docs.mapInArrow(scan, "doc_id bigint, finding bigint, category string, label string, match_preview string, context string")
