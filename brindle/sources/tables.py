"""Reading tables and JSON artifacts, and scoping what is read to a tenant."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_artifacts(spark: SparkSession, path: str, schema: StructType | str, contract_id: str | None = None) -> DataFrame:
    """Rows of JSON arrays of objects; old column names are for the caller to coalesce. Broken files fail the read."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows if contract_id is None else rows.filter(F.col("contract_id") == contract_id)


def tenant_scope(df: DataFrame, tenant: Column, current: int | None, is_super: bool = False, nulls: str = "hidden", no_context: bool = False) -> DataFrame:
    """Rows that a tenant may read. ``nulls``: whether rows of no tenant are 'hidden' or 'visible'; super users read all.

    ``no_context``: whether all rows may be read where no tenant is set, as those of invitations.
    """
    if is_super or no_context and current is None:
        return df
    own = tenant == F.lit(current) if current is not None else F.lit(False)
    return df.filter(own | tenant.isNull() if nulls == "visible" else own & tenant.isNotNull())


def replace_documents(existing: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Delete-then-insert by document: what ``fresh`` holds replaces the rows of its documents."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def unique_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; the upsert's batch without repeated ids."""
    from ..operators.windows import top_per_key

    return top_per_key(df, [key], order, 1)


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the folder that the session names in spark.checkpoint.dir, with its lineage cut.

    Only a local session without such a folder gets one of its own.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="brindle-"))
    return df.checkpoint()
