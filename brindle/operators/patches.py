"""Ordered patches over versioned rows: hash locks, the stop at the first failure, what is in force, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judge(ops: DataFrame, base: DataFrame) -> DataFrame:
    """Adds error (null where an operation applies), failed_patch and status to operations in their order.

    ``ops``: contract, effective_date, patch_id, op_no, target, expected, value, approved, sourced; a patch names a target
    once. ``base``: contract, target, value. Operations run by (date, patch, number). An operation that isn't approved is
    left out; it fails without sources, without its target, or where the hash that it expects isn't that of the value in
    force, which the operations before have put there. The first patch that fails ends its contract: nothing later runs,
    and nothing is applied at all.
    """
    in_order = Window.partitionBy("contract", "target").orderBy("effective_date", "patch_id", "op_no")
    before = F.last(F.when(F.col("approved"), F.col("value")), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    told = ops.join(base.select("contract", "target", F.col("value").alias("_base"), F.lit(True).alias("_known")), ["contract", "target"], "left").withColumn("_held", F.coalesce(before, F.col("_base")))
    error = (
        F.when(~F.col("approved"), "review_status_not_approved").when(~F.col("sourced"), "missing_source_refs").when(F.col("_known").isNull(), "target_not_found")
        .when(F.sha2(F.col("_held").cast("string"), 256) != F.col("expected"), "expected_hash_mismatch")
    )
    told = told.withColumn("error", error)
    failed = told.filter("error IS NOT NULL AND error != 'review_status_not_approved'").groupBy("contract").agg(F.min(F.struct("effective_date", "patch_id")).alias("_failed"))
    joined = told.join(failed, "contract", "left")
    reached = F.col("_failed").isNull() | (F.struct("effective_date", "patch_id") <= F.col("_failed"))
    status = F.when(~reached, "not_reached").when(F.col("error").isNotNull(), "failed").when(F.col("_failed").isNotNull(), "rolled_back").otherwise("applied")
    return joined.select(*ops.columns, F.when(reached, F.col("error")).alias("error"), F.col("_failed.patch_id").alias("failed_patch"), F.when(reached & (F.col("error") == "review_status_not_approved"), "skipped").otherwise(status).alias("status"))


def in_force(judged: DataFrame, base: DataFrame) -> DataFrame:
    """The base rows with the last applied value of each target, and the patch that it comes from."""
    last = judged.filter("status = 'applied'").groupBy("contract", "target").agg(F.max(F.struct("effective_date", "patch_id", "op_no", "value")).alias("m"))
    return base.join(last, ["contract", "target"], "left").select("contract", "target", F.coalesce("m.value", base["value"]).alias("value"), F.col("m.patch_id").alias("patch_id"))


def supersede_strict(base: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """History and newer rows, each with error 'key_conflict' where a newer row's key stands in the base already."""
    had = base.select(*keys).withColumn("_had", F.lit(True)).distinct()
    told = newer.join(had, keys, "left").withColumn("error", F.when(F.col("_had"), "key_conflict")).drop("_had")
    return base.withColumn("error", F.lit(None).cast("string")).unionByName(told)
