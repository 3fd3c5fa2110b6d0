"""A table of vectors by id that takes upserts, deletes and resets, and answers by id.

Rows lie in batches, and in a batch by buckets of their ids; a delete is a row without a vector. A commit is one small file that a writer
creates once a batch is complete: what no commit names isn't read, and of two writers of one number the second one fails. Commits carry
the number of live rows, found from the ids of the touched buckets alone, so that a count reads no row. A read by id opens one bucket,
where the files' bloom filters leave out those without the id. Compaction writes the live rows as a batch that stands for all before it.

Ids are strings or integers and not null; of rows of one batch that share an id, one stays (the largest by its columns).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import _filesystem

BUCKETS = 32


class VectorSink:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = BUCKETS):
        """``schema``: the DDL of the rows; ``key``: their id. The number of buckets is that of the first opening."""
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.stored = f"{schema}, _gone boolean, _bucket int"
        self.fs, _ = _filesystem(spark, path)

    def _path(self, name: str):
        return _filesystem(self.spark, f"{self.path}/{name}")[1]

    def commits(self) -> list[dict]:
        """The commits in order, from the last one that stands for all before it."""
        if not self.fs.exists(self._path("commits")):
            return []
        found = sorted(str(f.getPath().getName()) for f in self.fs.listStatus(self._path("commits")))
        out: list[dict] = []
        for name in found:
            stream = self.fs.open(self._path(f"commits/{name}"))
            try:
                told = json.loads(stream.readUTF())
            finally:
                stream.close()
            out = [told] if told["first"] == told["batch"] else [*out, told]
        return out

    def _commit(self, batch: int, live: int, first: int) -> None:
        stream = self.fs.create(self._path(f"commits/{batch:012d}"), False)
        try:
            stream.writeUTF(json.dumps({"batch": batch, "live": live, "first": first}))
        finally:
            stream.close()

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        """All rows that commits name, with the number of their batch."""
        out = self.spark.createDataFrame([], f"{self.stored}, _batch bigint")
        for c in self.commits():
            if self.fs.exists(self._path(f"data/{c['batch']}")):
                out = out.unionByName(self.spark.read.schema(self.stored).parquet(f"{self.path}/data/{c['batch']}").withColumn("_batch", F.lit(c["batch"]).cast("bigint")))
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        named = [c for c in rows.columns if c not in (self.key, "_batch")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*named), "_batch").alias("_r"))
        return last.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in named])

    def _write(self, rows: DataFrame, batch: int) -> None:
        made = f"{self.path}/making-{uuid.uuid4().hex}"
        bloom = {f"parquet.bloom.filter.enabled#{self.key}": "true", f"parquet.bloom.filter.expected.ndv#{self.key}": "100000"}
        rows.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.options(**bloom).partitionBy("_bucket").parquet(made)
        self.fs.mkdirs(self._path("data"))
        if not self.fs.rename(_filesystem(self.spark, made)[1], self._path(f"data/{batch}")):
            raise OSError(f"batch {batch} exists")

    def _append(self, rows: DataFrame) -> None:
        done = self.commits()
        batch, live = (done[-1]["batch"] + 1, done[-1]["live"]) if done else (0, 0)
        self._write(rows, batch)
        fresh = self.spark.read.schema(self.stored).parquet(f"{self.path}/data/{batch}").select(self.key, F.col("_gone").alias("_leaves"), "_bucket")
        touched = fresh.select("_bucket").distinct()
        had = self._latest(self._rows().select(self.key, "_gone", "_bucket", "_batch").join(F.broadcast(touched), "_bucket", "left_semi")).filter("NOT _gone").select(self.key, F.lit(True).alias("_had"))
        change = F.sum(F.when(F.col("_leaves"), F.when(F.col("_had"), -1).otherwise(0)).otherwise(F.when(F.col("_had"), 0).otherwise(1)))
        moved = fresh.join(had, self.key, "left").agg(change).first()[0] or 0
        self._commit(batch, live + moved, done[0]["first"] if done else 0)

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows, and replaces those with their ids."""
        named = [f.name for f in self.schema if f.name != self.key]
        one = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*named)).alias("_r")).select(self.key, *[F.col(f"_r.{c}").alias(c) for c in named])
        self._append(one.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("_gone", F.lit(False)).withColumn("_bucket", self._bucket(F.col(self.key))))

    def delete(self, ids: DataFrame) -> None:
        """Takes the ids' rows away, where there are any."""
        gone = ids.select(F.col(self.key).cast(self.schema[self.key].dataType)).filter(F.col(self.key).isNotNull()).distinct()
        rows = gone.select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        self._append(rows.withColumn("_gone", F.lit(True)).withColumn("_bucket", self._bucket(F.col(self.key))))

    def current(self) -> DataFrame:
        """The live rows."""
        return self._latest(self._rows()).filter("NOT _gone").select(*[f.name for f in self.schema])

    def get(self, ids: list) -> DataFrame:
        """The live rows of some ids; only their buckets are opened, and only files whose filters don't exclude them."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(i,) for i in ids], f"{self.key} {kind.simpleString()}").select(self._bucket(F.col(self.key)).alias("b")).distinct()
        buckets = [r.b for r in asked.collect()]
        rows = self._rows().filter(F.col("_bucket").isin(*buckets) & F.col(self.key).isin(*ids))
        return self._latest(rows).filter("NOT _gone").select(*[f.name for f in self.schema])

    def count(self) -> int:
        """The number of live rows, from the last commit."""
        done = self.commits()
        return done[-1]["live"] if done else 0

    def reset(self) -> None:
        """Leaves no row."""
        done = self.commits()
        batch = done[-1]["batch"] + 1 if done else 0
        self._commit(batch, 0, batch)

    def compact(self) -> None:
        """Writes the live rows as one batch; older batches aren't read any more, and ``vacuum`` removes them."""
        done = self.commits()
        if done:
            batch = done[-1]["batch"] + 1
            self._write(self.current().withColumn("_gone", F.lit(False)).withColumn("_bucket", self._bucket(F.col(self.key))), batch)
            self._commit(batch, done[-1]["live"], batch)

    def vacuum(self) -> None:
        """Removes batches and commits that no read needs any more; reads that are under way must be over."""
        first = (self.commits() or [{"first": 0}])[0]["first"]
        for folder in ("commits", "data"):
            if self.fs.exists(self._path(folder)):
                for f in self.fs.listStatus(self._path(folder)):
                    if int(f.getPath().getName()) < first:
                        self.fs.delete(f.getPath(), True)
