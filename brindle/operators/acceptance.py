"""Acceptance of packs: declared checks, compiled to one aggregate per table and one join per reference, for all packs at once.

A measure counts or rates a table's rows of a contract; a reference counts the values of a column that another table lacks. A check
passes where its condition holds of ``x``, its measure. Measures of tables without a row of the contract are those of no rows: counts are 0,
shares null, and a null passes nothing but where the condition says so. A reference's missing values count once each; nulls refer to
nothing. A pack is accepted if no required check fails, and in strict judgement no advisory one either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """``measure`` is an SQL aggregate over the rows of a table."""

    check_id: str
    table: str
    measure: str
    passes: str = "x = 0"
    severity: str = "required"


@dataclass(frozen=True)
class Reference:
    """The distinct values of ``column`` that ``other``'s column lacks; with ``share``, ``x`` is the share of those that it holds."""

    check_id: str
    table: str
    column: str
    other: str
    other_column: str
    passes: str = "x = 0"
    severity: str = "required"
    share: bool = False


# The checks of a pack, their conditions and thresholds.
CHECKS: tuple[Measure | Reference, ...] = (
    Measure("manifest_exists", "manifests", "count(*)", "x > 0"),
    Measure("manifest_schema_valid", "manifests", "count_if(contract_id IS NULL OR union_local IS NULL OR term_start IS NULL)"),
    Measure("source_pdf_exists", "manifests", "max(coalesce(pdf_bytes, 0))", "x > 0"),
    Measure("query_routing_coverage", "routes", "count(DISTINCT topic)", "x >= 2"),
    Reference("query_routing_article_ref_integrity", "routes", "article", "articles", "article"),
    Measure("chunks_exists", "chunks", "count(*)", "x > 0"),
    Measure("chunks_non_empty", "chunks", "count_if(trim(coalesce(content, '')) <> '')", "x > 0"),
    Measure("chunks_contract_scope", "chunks", "count_if(contract_id IS NULL)"),
    Measure("chunks_region_scope", "chunks", "count_if(region_id IS NULL)"),
    Measure("chunk_id_uniqueness", "chunks", "count(*) - count(DISTINCT chunk_id)", severity="advisory"),
    Measure("chunk_citation_normalization", "chunks", "count_if(citation IS NOT NULL AND citation NOT LIKE 'Article %' AND citation NOT LIKE 'Appendix %' AND citation NOT LIKE 'Letter %')", severity="advisory"),
    Measure("language_feature_coverage", "chunks", "avg(CASE WHEN has_questions THEN 1.0 ELSE 0.0 END)", "x >= 0.5"),
    Measure("side_letter_doc_type_materialization", "chunks", "count_if(citation LIKE 'Letter %' AND doc_type <> 'lou')"),
    Reference("article_coverage", "articles", "article", "chunks", "article", "x >= 0.95", share=True),
    Reference("manifest_article_index_completeness", "articles", "article", "nav", "article"),
    Measure("tables_registry_exists", "tables", "count(*)", "x > 0", "advisory"),
    Reference("table_ref_integrity", "chunks", "table_ref", "tables", "table_id"),
    Measure("concept_index_non_empty", "concepts", "count(*)", "x > 0"),
    Measure("language_lexicon_non_empty", "lexicon", "count(DISTINCT alias)", "x > 0"),
    Measure("language_lexicon_region_id", "lexicon", "count_if(region_id IS NULL)"),
    Measure("pdf_nav_index_non_empty", "nav", "count(DISTINCT article)", "x > 0"),
    Measure("pdf_nav_index_schema_valid", "nav", "count_if(page IS NULL OR page < 1)"),
    Measure("contract_outline_non_empty", "outline", "count(*)", "x > 0"),
    Reference("contract_outline_chunk_coverage", "chunks", "chunk_id", "outline", "chunk_id"),
    Measure("wages_exists", "wages", "count(*)", "x > 0"),
    Measure("wage_classifications_non_empty", "wages", "count(DISTINCT class_key)", "x > 0"),
    Reference("wage_primary_lookup_integrity", "lookups", "class_key", "wages", "class_key"),
    Measure("canonical_wage_rows_present", "wages", "count_if(canonical)", "x > 0"),
    Measure("canonical_wage_row_schema_valid", "wages", "count_if(canonical AND (rate IS NULL OR rate <= 0 OR effective_date IS NULL OR class_key IS NULL))"),
    Measure("canonical_wage_row_contradictions", "wages", "count(DISTINCT CASE WHEN canonical THEN concat_ws('|', class_key, effective_date, step, CAST(rate AS DECIMAL(12, 4))) END) - count(DISTINCT CASE WHEN canonical THEN concat_ws('|', class_key, effective_date, step) END)", severity="advisory"),
    Measure("canonical_wage_conflict_rate", "wages", "avg(CASE WHEN conflict THEN 1.0 ELSE 0.0 END)", "coalesce(x, 0) <= 0.05", "advisory"),
    Measure("canonical_wage_ambiguity_rate", "wages", "avg(CASE WHEN ambiguous THEN 1.0 ELSE 0.0 END)", "coalesce(x, 0) <= 0.05", "advisory"),
    Reference("manifest_classification_wage_coverage", "classes", "class_key", "wages", "class_key", "x >= 0.6", "advisory", share=True),
    Reference("critical_alias_resolution", "lexicon", "critical_class", "wages", "class_key"),
    Measure("vacation_entitlement_non_empty", "entitlements", "count_if(kind = 'vacation')", "x > 0"),
    Measure("entitlements_schema_valid", "entitlements", "count_if(years IS NULL OR weeks IS NULL OR weeks <= 0)"),
    Reference("classification_ontology_alias_integrity", "ontology", "target", "classes", "class_key"),
    Reference("classification_ontology_manifest_decisions", "classes", "class_key", "ontology", "class_key"),
    Measure("classification_ontology_mapping_coverage", "ontology", "avg(CASE WHEN wage_key IS NOT NULL THEN 1.0 ELSE 0.0 END)", "x >= 0.5", "advisory"),
    Measure("role_catalog_schema_valid", "roles", "count_if(role_id IS NULL OR label IS NULL)"),
    Reference("role_catalog_onboarding_default_wage_ready", "roles", "default_class", "wages", "class_key"),
    Measure("role_catalog_unresolved_manifest_rate", "roles", "avg(CASE WHEN unresolved THEN 1.0 ELSE 0.0 END)", "coalesce(x, 0) <= 0.4", "advisory"),
    Reference("ingestion_review_queue_issue_coverage", "issues", "issue", "reviews", "issue"),
    Measure("ingestion_review_queue_schema_valid", "reviews", "count_if(severity NOT IN ('high', 'medium', 'low') OR issue IS NULL)"),
    Measure("miss_record_backlog_linkage", "misses", "count_if(backlog_id IS NULL)", severity="advisory"),
)


def evaluate(packs: DataFrame, tables: dict[str, DataFrame], checks: tuple[Measure | Reference, ...] = CHECKS) -> DataFrame:
    """(contract, check_id, severity, passed, metric) of each check of each pack. ``packs`` and all tables have a column contract."""
    asked = packs.select("contract").distinct()
    measures: dict[str, list[tuple[int, Measure]]] = {}
    for i, c in enumerate(checks):
        if isinstance(c, Measure):
            measures.setdefault(c.table, []).append((i, c))
    joined = asked
    for name, of in measures.items():
        joined = joined.join(tables[name].groupBy("contract").agg(*[F.expr(c.measure).cast("double").alias(f"_{i}") for i, c in of]), "contract", "left")
    for i, c in enumerate(checks):
        if isinstance(c, Reference):
            said = tables[c.table].select("contract", F.col(c.column).cast("string").alias("_v")).filter("_v IS NOT NULL").distinct()
            held = tables[c.other].select("contract", F.col(c.other_column).cast("string").alias("_v")).distinct().withColumn("_there", F.lit(1))
            counts = said.join(held, ["contract", "_v"], "left").groupBy("contract").agg((F.count(F.lit(1)) - F.count("_there")).alias("_missing"), F.count(F.lit(1)).alias("_all"))
            x = 1 - F.col("_missing") / F.col("_all") if c.share else F.col("_missing")
            joined = joined.join(counts.select("contract", x.cast("double").alias(f"_{i}")), "contract", "left")
    out = []
    for i, c in enumerate(checks):
        rate = isinstance(c, Reference) and c.share or isinstance(c, Measure) and c.measure.startswith("avg(")
        x = F.col(f"_{i}") if rate else F.coalesce(F.col(f"_{i}"), F.lit(0.0))
        out.append(F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"), x.alias("x"), F.lit(c.passes).alias("rule")))
    told = joined.select("contract", F.explode(F.array(*out)).alias("_c")).select("contract", "_c.*")
    passed = F.lit(False)
    for rule in dict.fromkeys(c.passes for c in checks):
        passed = F.when(F.col("rule") == rule, F.coalesce(F.expr(rule), F.lit(False))).otherwise(passed)
    return told.select("contract", "check_id", "severity", passed.alias("passed"), F.col("x").alias("metric"))


def scorecard(results: DataFrame, strict: bool = False) -> DataFrame:
    """(contract, required_failed, advisory_failed, accepted): the failed checks of each pack in their order by name, and the judgement."""
    failed = lambda s: F.array_sort(F.collect_list(F.when((F.col("severity") == s) & ~F.col("passed"), F.col("check_id"))))
    told = results.groupBy("contract").agg(failed("required").alias("required_failed"), failed("advisory").alias("advisory_failed"))
    return told.withColumn("accepted", (F.size("required_failed") == 0) & (F.lit(not strict) | (F.size("advisory_failed") == 0)))
