"""Shared storage between the steps of a job, and connected components of links."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def tidy(run: Callable[[Iterator], Iterator], *caches: dict) -> Callable[[Iterator], Iterator]:
    """``run``, and after a task's last batch its memory goes back to the machine: workers stay for tasks of other jobs."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc, or no dynamic linking: nothing to trim


#: The folders opened within each ``released`` block that is under way.
_released: list[list[Scratch]] = []


@contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, the folders that operators have opened in the block: by then their results must be written."""
    _released.append([])
    try:
        yield
    finally:
        for scratch in _released.pop():
            scratch.close()


class Scratch:
    """A folder of tables under spark.checkpoint.dir, which driver and executors share.

    A table written here cuts the lineage: a lost executor's work is read again, not done again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="brindle-")
            spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        self.path = f"{root.rstrip('/')}/brindle-{uuid.uuid4().hex}"
        for held in _released[-1:]:
            held.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        held = self.spark.conf.get(_BATCH)
        # Whole texts go to Python in batches of some MB: a worker has two of them at a time.
        self.spark.conf.set(_BATCH, str(min(int(held), BATCH_ROWS)) if int(held) > 0 else str(BATCH_ROWS))
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_BATCH, held)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Removes the folder, once nothing reads its tables any more."""
        self.drop("")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (a, b: long) that isn't the smallest of its component.

    Alternates two steps until nothing changes: larger neighbours are linked to a node's smallest neighbour, then
    smaller ones. Edges never grow in number, the rounds are logarithmic, and no step gathers a node's neighbours:
    there are only minima per node, joined back to the edges. The minima are written first, so that both sides of such
    a join are plain shuffles, which Spark splits where a node is hot; nodes that have settled take no part in it.
    """
    made = 0

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        nonlocal made
        made += 1
        table = scratch.table(df, f"{name}-{made}")
        state = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if made > 2:
            scratch.drop(f"{name}-{made - 2}")
        return table, tuple(state)

    linked = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e, state = stored(linked)
    for _ in range(max_rounds):
        if not state[0]:
            break
        ends = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        lower = scratch.table(ends.groupBy("x").agg(F.min("y").alias("m")).filter("m < x").select(F.col("x").alias("v"), "m"), f"{name}-lower")
        large = e.join(lower, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        e, _ = stored(large)
        least = scratch.table(e.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        before = state
        e, state = stored(small)
        if state == before:
            break
    else:
        raise RuntimeError(f"components didn't settle within {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))


class Unions:
    """Components among a task's own rows, by position; the smallest position leads."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = a = p[p[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
