"""Incremental event aggregates: daily totals with a watermark, and an idempotent upsert per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 25) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_totals(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Events and value per day and type; rows later than ``lateness`` are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return stamped.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(
        F.to_date("w.start").alias("day"), "event_type", "events", "value"
    )


def lookback_totals(events: DataFrame, span: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return stamped.groupBy(F.window("ts", span, slide).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("value").alias("cost")).select("w.start", "w.end", "user_id", "requests", "cost")


def write_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """The newest row of each key over all batches so far.

    Each batch merges the stored rows with its own and writes them under its number, beside the state that it began
    from; a batch that runs again starts from the same state and replaces itself. ``latest`` reads the last one.
    """
    from ..operators.windows import top_per_key

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _last_batch(spark, path, number)
        rows = batch if before is None else spark.read.schema(batch.schema).parquet(f"{path}/batch={before}").unionByName(batch)
        top_per_key(rows, keys, [F.col(order).desc()]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the last complete batch of ``write_latest`` left."""
    return spark.read.parquet(f"{path}/batch={_last_batch(spark, path)}")


def _last_batch(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The number of the last batch that was written whole, below ``before``."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(fs_path(f"{path}/batch=*/_SUCCESS")) or []
    numbers = [int(str(f.getPath().getParent().getName()).removeprefix("batch=")) for f in found]
    return max((n for n in numbers if before is None or n < before), default=None)
