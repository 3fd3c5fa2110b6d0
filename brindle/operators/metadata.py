"""Metadata as JSON, merged by path: later documents win.

Documents become rows of a path and a leaf. A leaf stays unless a later document has a leaf at its path, above it (the later value
replaces the whole object) or below it (a later object replaces the value).

Defined results: arrays, nulls and empty objects are leaves, so that a later null or array wins as it is; an empty object says nothing
and is left out; texts that aren't JSON objects hold nothing; orders are unique within a key, and of documents that share one the larger
value in text order wins at each path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 100


def leaves(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, value): the leaves of each object; ``path`` is an array of keys, ``value`` its JSON. A round of work a level."""
    spark = df.sparkSession
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    todo = df.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("_v")).filter(is_object(F.col("_v")))
    out = None
    for _ in range(MOST_DEPTH):
        below = todo.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*keys, F.array_append("path", F.col("key")).alias("path"), F.col("value").alias("_v"))
        told = below.withColumn("_object", is_object(F.col("_v")))
        found = told.filter("NOT _object").select(*keys, "path", F.to_json("_v").alias("value"))
        out = found if out is None else out.unionByName(found)
        todo = told.filter("_object").drop("_object")
        if todo.isEmpty():
            return out
    raise ValueError(f"metadata nested deeper than {MOST_DEPTH} levels")


def merge_later_wins(df: DataFrame, key: str, order: str, json: str) -> DataFrame:
    """(key, path, value) of the merged metadata of each key; ``path`` is an array of keys."""
    rows = leaves(df, [key, order], json).groupBy(key, order, "path").agg(F.max("value").alias("value"))
    at = rows.groupBy(key, "path").agg(F.max(order).alias("_at"), F.max_by("value", F.struct(order, "value")).alias("value"))
    above = at.select(key, "path", "_at").withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))))
    # The latest leaf above a path, and below it.
    higher = above.filter(F.size("_up") < F.size("path")).select(key, "path", "_up").join(at.select(key, F.col("path").alias("_up"), F.col("_at").alias("_u")), [key, "_up"])
    higher = higher.groupBy(key, "path").agg(F.max("_u").alias("_above"))
    lower = above.filter(F.size("_up") < F.size("path")).groupBy(key, F.col("_up").alias("path")).agg(F.max("_at").alias("_below"))
    told = at.join(higher, [key, "path"], "left").join(lower, [key, "path"], "left")
    stays = ~(_later("_above") | _later("_below"))
    return told.filter(stays).select(key, "path", "value")


def _later(other: str) -> Column:
    return F.coalesce(F.col(other) > F.col("_at"), F.lit(False))
