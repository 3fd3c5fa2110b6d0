"""Versioned tables: guarded replacement, supersession, reconciliation and hashes of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import ordinal


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def replace_guarded(base: DataFrame, patch: DataFrame, key: str, value: str, new_value: str, expected: str, current_hash: Column) -> DataFrame:
    """Rows with their patches applied where the hash that a patch expects is the row's; status tells what happened."""
    joined = base.join(patch.withColumn("_patched", F.lit(True)), key, "left")
    holds = F.col("_patched") & (F.col(expected) == current_hash)
    status = F.when(F.col("_patched").isNull(), "unchanged").when(holds, "replaced").otherwise("hash_mismatch")
    return joined.select(*[c for c in base.columns if c != value], F.when(holds, F.col(new_value)).otherwise(F.col(value)).alias(value), status.alias("status"))


def supersede(base: DataFrame, patch: DataFrame, key: str, date: str) -> DataFrame:
    """History and the newer rows; of a (key, date) that both hold, the newer row."""
    return base.join(patch.select(key, date), [key, date], "left_anti").unionByName(patch, allowMissingColumns=True)


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: only in one side, changed, or the same (nulls are equal)."""
    a = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    state = (
        F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def duplicate_suffix(df: DataFrame, name: str, order: list[str], out: str) -> DataFrame:
    """The first row of a name, by the one unique number in ``order``, keeps it; the others get __dup1, __dup2 and so on, in order."""
    numbered = ordinal(df, name, *order, "_n")
    return numbered.withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__dup"), (F.col("_n") - 1).cast("string")))).drop("_n")
