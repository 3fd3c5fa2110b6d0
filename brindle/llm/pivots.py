"""Near duplicates among vectors through inverted lists of pivots; every pair at the threshold is found.

A vector lives in the cell of its nearest pivot. It orders the other pivots by nearness too and looks into every cell
that may hold a vector within the threshold's angle: the members of a cell are no nearer to the seeker's own pivot than
to theirs, so the plane halfway between the two pivots parts them from the seeker, and a seeker that is further from
that plane than the angle allows has no partner behind it. All vectors of a cell are verified by their cosine in double
precision. A fixed number of probes, or of pivots shared, would be cheaper but loses pairs, most of all in large groups
of near copies. Where vectors have no structure the bound rules out few cells, and the search is all pairs.

Of two cells, the vectors of the one with the smaller number look into the other, so that a pair is met once.

Equal vectors are one entry with a count. Pivots are picked from a bounded sample of distinct vectors, chosen by hash,
so that no two are near each other: a large group of near copies stays in few cells. Cells are cut into blocks by hash,
so that a hot cell is many tasks, each with a bounded number of vectors; a block gives a row per vector with links,
never its pairs.

Vectors of different lengths have no cosine and don't link; each length has pivots and cells of its own. Components are
divided by the largest one first, so that no norm overflows or vanishes; vectors that are equal then are one entry.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors without an id, link
with nothing. Repeated rows are vectors of their own. An empty table gives an empty table. Further columns are dropped;
join them back by the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Unions, components

THRESHOLD = 0.95
#: Vectors of a cell on average, as far as the number of pivots allows.
CELL = 4000
MIN_PIVOTS, MAX_PIVOTS, SAMPLE = 8, 1024, 4096
#: Pivots' cosines stay below.
APART = 0.8
#: Vectors of a block at most, on average: those that live there, and those that look.
BLOCK_HOMES, BLOCK_PROBES = 6000, 12000
#: Seekers verified at once.
TILE = 128

_PLACED = "cell int, home_block int, probe_block int, home boolean, own boolean, rep bigint, n bigint, vec array<double>"
_FOUND = "rep bigint, links bigint, root bigint"


def _by_length(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small batches, each of vectors of one length."""
    for at in range(0, len(batch), rows):
        part = batch.slice(at, rows)
        lengths = part.column("vec").value_lengths().to_numpy()
        for n in np.unique(lengths).tolist():
            yield part if (lengths == n).all() else part.take(pa.array(np.flatnonzero(lengths == n)))


class _Pivots:
    """The pivots of each length, and the number of its first cell."""

    def __init__(self, points: list[np.ndarray]):
        firsts = np.cumsum([0] + [len(p) for p in points]).tolist()
        self.cells = firsts.pop()
        self.of = {p.shape[1]: (p, first) for p, first in zip(points, firsts, strict=True)}

    def places(self, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's home cell; and (row, cell) of all cells that are looked into."""
        points, first = self.of[vectors.shape[1]]
        home, looks = _places(vectors, points, threshold)
        row, cell = np.nonzero(looks)
        return home + np.int32(first), row, cell + first


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _apart(points: np.ndarray, most: int) -> np.ndarray:
    """The first unit vectors, ``most`` at most, of which each is away from all before it."""
    kept = points[:1]
    for p in points[1:]:
        if len(kept) == most:
            break
        if (kept @ p).max() < APART:
            kept = np.vstack([kept, p])
    return kept


def _places(vectors: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest pivot, and which cells it looks into: its own and those after it that the bound leaves."""
    near = _unit(vectors) @ pivots.T
    home = near.argmax(axis=1)
    looks = np.arange(len(pivots)) >= home[:, None]
    if threshold > 0:
        gap = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
        reach = (max(0.0, 1 - threshold * threshold) ** 0.5 + 1e-9) * gap[home]
        looks &= near[np.arange(len(near)), home][:, None] - near <= reach
    return home.astype(np.int32), looks


def _spread(reps: np.ndarray, salt: int) -> np.ndarray:
    mixed = (reps.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _search(threshold: float):
    def search(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        home, own = (block.column(c).to_numpy() for c in ("home", "own"))
        rep, n = block.column("rep").to_numpy(), block.column("n").to_numpy()
        vectors = _unit(_matrix(pa.concat_arrays(block.column("vec").chunks)))
        h, s = np.flatnonzero(home), np.flatnonzero(~home)
        h_vec, h_rep, h_n = vectors[h], rep[h], n[h].astype(float)
        reps = np.unique(rep)
        h_at = np.searchsorted(reps, h_rep)
        links, unions, led = np.zeros(len(reps)), Unions(len(reps)), np.arange(len(reps))
        for at in range(0, len(s), TILE):
            part = s[at : at + TILE]
            hit = vectors[part] @ h_vec.T >= threshold
            # Vectors of the cell itself look for each other: the one with the smaller id finds the pair.
            hit &= np.where(own[part][:, None], rep[part][:, None] < h_rep, True)
            rows = np.flatnonzero(hit.any(axis=1))
            if not len(rows):
                continue
            hit, part = hit[rows], part[rows]
            p_at, weight = np.searchsorted(reps, rep[part]), hit.astype(float)
            np.add.at(links, p_at, weight @ h_n)
            np.add.at(links, h_at, n[part].astype(float) @ weight)
            for i, me in enumerate(p_at.tolist()):
                theirs = h_at[hit[i]]
                known = led[theirs]
                # ``led`` holds a member of each one's component: mostly the same, so few are joined one by one.
                for other in [int(known[0])] if (known == known[0]).all() else np.unique(known).tolist():
                    unions.join(me, other)
                led[theirs] = led[me] = unions.find(me)
        root = reps[[unions.find(i) for i in range(len(reps))]]
        kept = (links > 0) | (root != reps)
        return pa.table({"rep": reps[kept], "links": links[kept].astype(np.int64), "root": root[kept]})

    return search


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept (the smallest id of its component) of every row."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    # The largest component is bound once a vector; named within the inner function it would be sought for each component.
    scaled = F.transform(F.array(F.array_max(F.transform("v", F.abs))), lambda m: F.transform("v", lambda x: x / m))[0]
    rows = rows.withColumn("v", scaled)
    entries = scratch.table(rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", F.col("v").alias("vec")), "entries")
    points = []
    for length, total in sorted((r["length"], r["count"]) for r in entries.groupBy(F.size("vec").alias("length")).count().collect()):
        wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, total // CELL))
        chosen = entries.filter(F.size("vec") == length).orderBy(F.xxhash64("vec"), "rep").limit(min(SAMPLE, 4 * wanted)).collect()
        points.append(_apart(_unit(np.array([r["vec"] for r in chosen])), wanted))
    if not points:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = _Pivots(points)
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, shared_pivots.value.cells), np.int64)
        for whole in batches:
            for b in _by_length(whole):
                home, _, cell = shared_pivots.value.places(_matrix(b.column("vec")), threshold)
                counts[0] += np.bincount(home, minlength=counts.shape[1])
                counts[1] += np.bincount(cell, minlength=counts.shape[1])
        role, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(role == 0), pa.array(counts[role, cell])], names=["cell", "home", "n"])

    # A row per pivot and role: bounded by MAX_PIVOTS for each length.
    counted = entries.mapInArrow(cells, "cell int, home boolean, n bigint").groupBy("cell", "home").agg(F.sum("n").alias("n")).collect()
    blocks = np.zeros((2, pivots.cells), np.int64)
    for r in counted:
        blocks[int(not r["home"]), r["cell"]] = -(-r["n"] // (BLOCK_HOMES if r["home"] else BLOCK_PROBES))
    shared_blocks = spark.sparkContext.broadcast(blocks)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home_blocks, probe_blocks = shared_blocks.value
        for whole in batches:
            for b in _by_length(whole):
                home, looker, looked = shared_pivots.value.places(_matrix(b.column("vec")), threshold)
                reps = b.column("rep").to_numpy()
                for role, salt, own, other, (row, cell) in ((True, 1, home_blocks, probe_blocks, (np.arange(len(b)), home)), (False, 2, probe_blocks, home_blocks, (looker, looked))):
                    mine = (_spread(reps, salt)[row] % own[cell].astype(np.uint64)).astype(np.int32)
                    times = other[cell]
                    # Each place once for each block of the other role.
                    row, cell, mine = np.repeat(row, times), np.repeat(cell, times).astype(np.int32), np.repeat(mine, times)
                    theirs = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
                    for cut in range(0, len(row), 4000):
                        c = slice(cut, cut + 4000)
                        take = pa.array(row[c])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell[c]), pa.array((mine if role else theirs)[c]), pa.array((theirs if role else mine)[c]), pa.array(np.full(len(take), role)), pa.array(home[row[c]] == cell[c]),
                             b.column("rep").take(take), b.column("n").take(take), b.column("vec").take(take)],
                            names=["cell", "home_block", "probe_block", "home", "own", "rep", "n", "vec"],
                        )

    found = entries.mapInArrow(placed, _PLACED).groupBy("cell", "home_block", "probe_block").applyInArrow(_search(threshold), _FOUND)
    found = scratch.table(found, "found")
    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        entries.join(links, "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
        .select(F.col("vec").alias("v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    return rows.join(known, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
