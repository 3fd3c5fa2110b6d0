"""Acceptance of packs made from forty parts each; their tables are the same expressions in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acceptance as A
from ..sources.tables import table
from .registry import Registry

registry = Registry()

_C, _K = "CAST(floor(p_partkey / 40) AS BIGINT)", "(p_partkey % 40)"
#: Name: (columns, rows). What a pack lacks follows from its number, so that each check fails for some packs and passes for others.
TABLES: dict[str, tuple[str, str]] = {
    "manifests": (f"{_C} AS contract, CASE WHEN {_C} % 17 = 3 THEN NULL ELSE {_C} END AS contract_id, 'local' AS union_local, '2022-01-01' AS term_start, CASE WHEN {_C} % 19 = 4 THEN 0 ELSE p_size END AS pdf_bytes", f"{_K} = 0 AND {_C} % 13 <> 5"),
    "articles": (f"{_C} AS contract, {_K} + 1 AS article", f"{_K} < 12"),
    "routes": (f"{_C} AS contract, p_type AS topic, {_K} % 12 + CASE WHEN {_C} % 7 = 2 THEN 2 ELSE 1 END AS article", f"{_K} < 12 AND {_C} % 23 <> 6"),
    "chunks": (
        f"{_C} AS contract, CASE WHEN {_C} % 11 = 3 AND {_K} = 7 THEN NULL ELSE {_C} END AS contract_id, CASE WHEN {_C} % 9 = 4 AND {_K} = 8 THEN NULL ELSE 'r1' END AS region_id, CASE WHEN {_C} % 8 = 1 AND {_K} = 9 THEN 'c0' ELSE concat('c', {_K}) END AS chunk_id, "
        f"CASE WHEN {_K} = 39 THEN 'Letter of Understanding 1' WHEN {_C} % 6 = 5 AND {_K} = 5 THEN 'art. 5' ELSE concat('Article ', {_K} % 12 + 1) END AS citation, CASE WHEN {_K} = 39 AND {_C} % 14 <> 9 THEN 'lou' ELSE 'cba' END AS doc_type, "
        f"{_K} % 12 + CASE WHEN {_C} % 12 = 7 THEN 2 ELSE 1 END AS article, p_partkey % 10 < {_C} % 11 AS has_questions, p_name AS content, CASE WHEN {_K} % 8 = 0 THEN concat('t', {_K}) END AS table_ref", f"{_C} % 29 <> 8"),
    "nav": (f"{_C} AS contract, {_K} + 1 AS article, CASE WHEN {_C} % 15 = 2 AND {_K} = 3 THEN 0 ELSE {_K} + 1 END AS page", f"{_K} < 12 - CASE WHEN {_C} % 10 = 6 THEN 1 ELSE 0 END AND {_C} % 44 <> 34"),
    "tables": (f"{_C} AS contract, concat('t', {_K}) AS table_id", f"{_K} % 8 = 0 AND {_C} % 6 <> 1"),
    "concepts": (f"{_C} AS contract, p_name AS concept", f"{_C} % 16 <> 11"),
    "lexicon": (f"{_C} AS contract, p_name AS alias, CASE WHEN {_C} % 18 = 12 AND {_K} = 1 THEN NULL ELSE 'r1' END AS region_id, CASE WHEN {_K} % 10 = 0 THEN concat('k', CAST(floor({_K} / 10) AS INT) % 4 + CASE WHEN {_C} % 21 = 10 THEN 3 ELSE 0 END) END AS critical_class", f"{_C} % 20 <> 13"),
    "outline": (f"{_C} AS contract, concat('c', {_K}) AS chunk_id", f"{_K} < 40 - CASE WHEN {_C} % 25 = 14 THEN 3 ELSE 0 END AND {_C} % 45 <> 35"),
    "wages": (
        f"{_C} AS contract, CASE WHEN {_C} % 22 = 15 AND {_K} = 2 THEN NULL ELSE concat('k', {_K} % 4) END AS class_key, CASE WHEN {_C} % 24 = 16 AND {_K} = 6 THEN -1 ELSE p_size END AS rate, '2022-01-01' AS effective_date, concat(CASE WHEN {_C} % 26 = 17 THEN '' ELSE concat({_K}, '') END, 's') AS step, "
        f"{_K} % 2 = 0 AND {_C} % 27 <> 18 AS canonical, {_K} % 5 = 0 AND {_C} % 28 = 19 AS conflict, {_K} % 4 = 0 AND {_C} % 30 = 20 AS ambiguous", f"{_C} % 31 <> 21"),
    "lookups": (f"{_C} AS contract, concat('k', {_K} % 4 + CASE WHEN {_C} % 32 = 22 THEN 1 ELSE 0 END) AS class_key", f"{_K} < 4"),
    "classes": (f"{_C} AS contract, concat('k', {_K} + CASE WHEN {_C} % 33 = 23 THEN 2 ELSE 0 END) AS class_key", f"{_K} < 4"),
    "entitlements": (f"{_C} AS contract, CASE WHEN {_C} % 34 = 24 THEN 'sick' ELSE 'vacation' END AS kind, {_K} AS years, CASE WHEN {_C} % 35 = 25 AND {_K} = 2 THEN 0 ELSE 2 END AS weeks", f"{_K} < 5"),
    "ontology": (f"{_C} AS contract, concat('k', {_K}) AS class_key, concat('k', {_K} + CASE WHEN {_C} % 36 = 26 THEN 1 ELSE 0 END) AS target, CASE WHEN {_K} > 0 AND {_C} % 37 = 27 THEN NULL ELSE 'w' END AS wage_key", f"{_K} < 4"),
    "roles": (f"{_C} AS contract, {_K} AS role_id, CASE WHEN {_C} % 38 = 28 AND {_K} = 1 THEN NULL ELSE p_name END AS label, concat('k', {_K} % 4 + CASE WHEN {_C} % 39 = 29 THEN 4 ELSE 0 END) AS default_class, {_K} % 2 = 0 AND {_C} % 40 = 30 AS unresolved", f"{_K} < 8"),
    "issues": (f"{_C} AS contract, concat('i', {_K} % 3) AS issue", f"{_K} < 6"),
    "reviews": (f"{_C} AS contract, concat('i', {_K} % 3) AS issue, CASE WHEN {_C} % 41 = 31 AND {_K} = 1 THEN 'urgent' ELSE 'high' END AS severity", f"{_K} < 3 - CASE WHEN {_C} % 42 = 32 THEN 1 ELSE 0 END"),
    "misses": (f"{_C} AS contract, CASE WHEN {_C} % 43 = 33 AND {_K} = 0 THEN NULL ELSE p_name END AS backlog_id", f"{_K} < 2"),
}


def pack_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    p = table(spark, sf, "part")
    return {name: p.filter(rows).selectExpr(*_columns(columns)) for name, (columns, rows) in TABLES.items()}


def _columns(text: str) -> list[str]:
    """The columns of a list of expressions, which hold commas within brackets only."""
    out, depth, begin = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[begin:i].strip())
            begin = i + 1
    return [*out, text[begin:].strip()]


def _sql() -> str:
    parts = ["packs AS (SELECT DISTINCT CAST(floor(p_partkey / 40) AS BIGINT) AS contract FROM part)"] + [f"{name} AS (SELECT {columns} FROM part WHERE {rows})" for name, (columns, rows) in TABLES.items()]
    each = []
    for c in A.CHECKS:
        if isinstance(c, A.Measure):
            x = f"(SELECT CAST({c.measure} AS DOUBLE) FROM {c.table} t WHERE t.contract = p.contract)"
            x = x if c.measure.startswith("avg(") else f"coalesce({x}, 0)"
        else:
            missing = f"count(*) FILTER (v NOT IN (SELECT CAST({c.other_column} AS VARCHAR) FROM {c.other} o WHERE o.contract = p.contract AND {c.other_column} IS NOT NULL))"
            what = f"1 - {missing} / count(*)" if c.share else missing
            x = f"(SELECT CAST({what} AS DOUBLE) FROM (SELECT DISTINCT CAST({c.column} AS VARCHAR) AS v FROM {c.table} t WHERE t.contract = p.contract AND {c.column} IS NOT NULL))"
        each.append(f"SELECT contract, '{c.check_id}' AS check_id, '{c.severity}' AS severity, coalesce({c.passes}, FALSE) AS passed, round(x, 6) AS metric FROM (SELECT p.contract, {x} AS x FROM packs p)")
    return "WITH " + ", ".join(parts) + ", results AS (" + " UNION ALL ".join(each) + ")"


PACKS_SQL = _sql()


def _results(spark: SparkSession, sf: str) -> DataFrame:
    packs = table(spark, sf, "part").selectExpr(f"{_C} AS contract").distinct()
    return A.evaluate(packs, pack_tables(spark, sf))


@registry.query(f"{PACKS_SQL} SELECT * FROM results")
def pack_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).withColumn("metric", F.round("metric", 6))


@registry.query(f"""{PACKS_SQL} SELECT contract, coalesce(string_agg(CASE WHEN severity = 'required' AND NOT passed THEN check_id END, ',' ORDER BY check_id), '') AS required_failed, coalesce(string_agg(CASE WHEN severity = 'advisory' AND NOT passed THEN check_id END, ',' ORDER BY check_id), '') AS advisory_failed,
count(*) FILTER (severity = 'required' AND NOT passed) = 0 AS accepted FROM results GROUP BY contract""")
def pack_scorecards(spark: SparkSession, sf: str) -> DataFrame:
    s = A.scorecard(_results(spark, sf))
    return s.select("contract", F.array_join("required_failed", ",").alias("required_failed"), F.array_join("advisory_failed", ",").alias("advisory_failed"), "accepted")
