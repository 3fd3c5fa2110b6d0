"""Merkle manifests of a dataset: a root digest of all rows, a subroot per source, and a proof for each row.

A row's leaf is the digest of its fields; a source's leaves ascend by id. Every 16 consecutive nodes of a level have one
parent, until one node is left: the subroot. Subroots, ordered by source, are the leaves of one more tree with the root.

The trees are built as an associative monoid of sparse forests. An element holds the nodes that have no parent yet, by
tree, level and index; adding two of them unites the nodes and replaces each run of siblings whose number is complete by
its parent, which may complete the next run. How many siblings a run has is known, since the leaves are counted first. Each
partition of the sorted leaves folds to a forest of its two ragged edges, some dozens of nodes a level; a tree of Spark
jobs adds neighbouring forests, FAN at a time, until one is left, which has resolved to the root. Completed runs are
written as they come and give the proofs: from the root down, each run gets the path of its parent, and each row the path
of its run.

Defined results: a null field is ``-``; null sources come first, null ids first in their source; rows that repeat a
source and an id ascend by leaf; equal rows take places beside each other; an empty table gives an empty manifest; further
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy

ARITY, FAN = 16, 16
#: The tree of the subroots; those of sources are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a fold: ``done`` runs with their digests, whose parent is at (level + 1, at), and nodes still open.
NODES = "chunk bigint, done boolean, tree bigint, level int, at bigint, n bigint, digest string, digests array<string>"
_ARROW = pa.schema(
    [("chunk", pa.int64()), ("done", pa.bool_()), ("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("digests", pa.list_(pa.string()))]
)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row's fields, each with its length before it."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Forest:
    """An element of the monoid; ``done`` collects the runs that have become complete, for the caller to take away."""

    def __init__(self, trees: int):
        self.trees = trees
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}
        self.size: dict[tuple[int, int], int] = {}
        self.done: list[tuple] = []
        self.root: str | None = None

    def add(self, tree: int, level: int, at: int, n: int, node: str) -> None:
        """Adds the node at a place of a level of ``n`` nodes, and the parents that it completes."""
        while True:
            if n == 1:
                self.done.append((tree, level, at, n, node, None))
                if tree == TOP:
                    self.root = node
                    return
                tree, level, at, n = TOP, 0, tree, self.trees
                continue
            run, place = divmod(at, ARITY)
            held = self.open.setdefault((tree, level, run), {})
            held[place] = node
            self.size[tree, level] = n
            if len(held) < min(ARITY, n - run * ARITY):
                return
            siblings = [held[i] for i in range(len(held))]
            del self.open[tree, level, run]
            node = digest(*siblings)
            self.done.append((tree, level, run, n, node, siblings))
            level, at, n = level + 1, run, -(-n // ARITY)

    def nodes(self) -> Iterator[tuple]:
        for (tree, level, run), held in self.open.items():
            for place, node in held.items():
                yield tree, level, run * ARITY + place, self.size[tree, level], node, None


def _fold(trees: int, fan: int):
    """Adds up the rows of each chunk: open nodes in, open nodes and completed runs out, under the number of the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, chunk, rows = Forest(trees), None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            rows.clear()
            return made

        def take(of) -> None:
            rows.extend((of, True, *x) for x in forest.done)
            forest.done.clear()

        def close(of) -> None:
            nonlocal forest
            take(of)
            rows.extend((of, False, *x) for x in forest.nodes())
            forest = Forest(trees)

        for batch in batches:
            for part, tree, level, at, n, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part //= fan
                if part != chunk and chunk is not None:
                    close(chunk)
                chunk = part
                forest.add(tree, level, at, n, node)
            take(chunk)
            yield out()
        if chunk is not None:
            close(chunk)
            yield out()

    return tidy(run)


def place(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The leaves (source, doc_id, leaf, ...) with part, pos, tree, at and n; and the number of trees.

    Ranges of the sort order are the partitions, so that a source that holds most rows spreads over many. Only counts per
    range and source are summed up: as many rows as there are ranges and sources.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    ids = F.monotonically_increasing_id()
    ordered = scratch.table(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", ids).withColumn("part", F.shiftright("pos", 33)), "ordered")
    spans = scratch.table(ordered.groupBy("part", "source").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("held")), "spans")
    starts = spans.groupBy("source").agg(F.min("part").alias("part"), F.sum("held").alias("n"))
    per_part = starts.groupBy("part").agg(F.count(F.lit(1)).alias("begun"))
    # One row a range goes through this window.
    before = per_part.select("part", (F.sum("begun").over(Window.orderBy("part")) - F.col("begun")).alias("before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())) - 1
    trees = starts.withColumn("here", here).join(before, "part").select(F.col("source").alias("of"), (F.col("before") + F.col("here")).alias("tree"), "n")
    earlier = F.sum("held").over(Window.partitionBy("source").orderBy("part")) - F.col("held")
    spans = spans.withColumn("earlier", earlier).join(trees, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumnsRenamed({"source": "of", "part": "in"})
    placed = ordered.join(spans, (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of")))
    placed = placed.withColumn("at", F.col("pos") - F.col("first") + F.col("earlier")).drop("of", "in", "first", "held", "earlier")
    return scratch.table(placed, "placed"), starts.count()


def tree_reduce(placed: DataFrame, trees: int, scratch: Scratch) -> DataFrame:
    """All completed runs and tops of trees, from the sums of neighbouring forests."""
    node = ["tree", "level", "at", "n", "digest"]
    todo = placed.select("part", "tree", F.lit(0).alias("level"), "at", "n", F.col("leaf").alias("digest"), "pos")
    runs, fan, number = None, 1, 0
    while True:
        sorted_ = todo.repartition(F.expr(f"part div {fan}")).sortWithinPartitions("part", "pos").select("part", *node)
        made = scratch.table(sorted_.mapInArrow(_fold(trees, fan), NODES), f"forests-{number}")
        done = made.filter("done")
        runs = done if runs is None else runs.unionByName(done)
        todo = made.filter("NOT done").select(F.col("chunk").alias("part"), *node, F.col("at").alias("pos"))
        if todo.isEmpty():
            return runs
        fan, number = FAN, number + 1


SIBLINGS = "array<struct<l:string,r:string>>"


def _children(runs: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """(tree, at, path, subroot) of the nodes of a level below the given parents."""
    own = runs.filter((F.col("level") == level) & F.col("digests").isNotNull()).select("tree", "at", "digests")
    return own.join(above, ["tree", "at"]).select("tree", F.posexplode("digests").alias("place", "digest"), "at", "digests", "path", "subroot").select(
        "tree", (F.col("at") * ARITY + F.col("place")).alias("at"),
        F.concat(F.array(_beside("place")), "path").alias("path"), "subroot",
    )


def _beside(place: str) -> Column:
    """The run's digests before and behind a place, as one text each."""
    return F.expr(f"named_struct('l', array_join(slice(digests, 1, {place}), ''), 'r', array_join(slice(digests, {place} + 2, {ARITY}), ''))")


def manifest(
    df: DataFrame,
    scratch: Scratch,
    fields: tuple[str, ...] = FIELDS,
    doc_id: str = "doc_id",
    source: str = "source",
    tampered: Column | None = None,
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Rows with ``tampered`` are folded with a leaf of the ``altered`` fields and the original siblings.
    """
    own = leaf_of([F.col(f) for f in fields])
    bad = F.when(tampered, leaf_of([(altered or {}).get(f, F.col(f)) for f in fields])) if tampered is not None else F.lit(None).cast("string")
    leaves = df.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("bigint").alias("doc_id"), own.alias("leaf"), bad.alias("bad"))
    placed, trees = place(scratch.table(leaves, "leaves"), scratch)
    runs = tree_reduce(placed, trees, scratch)
    tops = {r.of: r.most for r in runs.groupBy((F.col("tree") == TOP).alias("of")).agg(F.max("level").alias("most")).collect()}
    root = runs.filter((F.col("tree") == TOP) & F.col("digests").isNull()).select("digest").first()

    # From the root down the tree of subroots, then from each subroot down its own tree.
    top = runs.filter(F.col("tree") == TOP)
    above = top.filter("digests IS NULL").select("tree", "at", F.expr(f"cast(array() AS {SIBLINGS})").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for level in range(tops.get(True, 0) - 1, -1, -1):
        above = _children(top, above, level)
    roots = runs.filter((F.col("tree") != TOP) & F.col("digests").isNull()).select("tree", "level", "digest")
    roots = roots.join(above.select(F.col("at").alias("tree"), "path"), "tree").select("tree", F.lit(0).cast("bigint").alias("at"), "level", "path", F.col("digest").alias("subroot"))
    roots = scratch.table(roots, "roots")
    above = None
    for level in range(tops.get(False, 0), 0, -1):
        here = roots.filter(F.col("level") == level).drop("level")
        above = here if above is None else here.unionByName(_children(runs, above, level))
    lone = roots.filter("level = 0").select("tree", "at", "path", "subroot", F.lit(None).cast("array<string>").alias("digests"))
    if above is not None:
        first = runs.filter((F.col("level") == 0) & (F.col("tree") != TOP) & F.col("digests").isNotNull()).select("tree", "at", "digests")
        lone = lone.unionByName(first.join(above, ["tree", "at"]))
    lone = scratch.table(lone.withColumnRenamed("at", "run"), "paths")

    rows = placed.withColumn("run", F.expr(f"`at` div {ARITY}")).withColumn("place", F.expr(f"cast(`at` % {ARITY} AS int)"))
    rows = rows.join(lone, ["tree", "run"]).withColumn("path", F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.concat(F.array(_beside("place")), "path")))
    folded = F.expr("aggregate(path, coalesce(bad, leaf), (a, s) -> sha2(concat(s.l, a, s.r), 256))")
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root.digest if root else "").alias("root"),
        F.expr("sha2(array_join(transform(path, s -> concat(s.l, s.r)), ''), 256)").alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
