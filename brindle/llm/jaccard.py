"""Exact Jaccard join of texts on word n-grams with signature trees.

Texts are sets of hashes (64 bits) of their n-grams of words; texts with equal sets are a class, of the smallest id.

1. Dealing. Two sets with a similarity of the threshold or more differ in H tokens at most, where H follows from their
   sizes. Tokens are dealt to H + 1 + Z parts by hash: such sets agree in 1 + Z parts or more. A set whose empty parts
   number Z or fewer thus agrees with its partner in a part with tokens, and a hash of the part's tokens finds it; a
   set with more empty parts offers those as well. Sizes form classes of ratio 1 / threshold; a set takes part in its own
   class and in the one below. One shuffle of the parts' hashes, read in order as a stream, links sets that meet. No link is
   lost, and short parts of a frequent passage rarely meet by themselves.
2. Each signature's first set leads it, and a candidate group is all sets that a set leads: it holds any two sets that
   meet where that set is the first, while groups don't grow together through chance meetings. Groups of over BLOCK
   sets are split by size class, then into blocks by hash of the id, and the blocks' pairs are tasks of their own, so
   that no task grows with a group. Groups are first narrowed by the sets' bitmaps alone, a fraction of the sets' size,
   to components of what the largest possible overlap can't tell apart; only those are compared by their sets.
3. In a task, the sets of a group are the leaves of a signature tree. Nodes hold the union of their sets' bitmaps, their
   range of sizes and the most tokens that shared a bit. A dual traversal leaves out pairs of nodes whose largest
   possible overlap is too small, or whose sets are linked already; what reaches the leaves is compared exactly.
   A task gives one row per set at most: the smallest set that it is linked with.
4. Components of those rows are the result.

Defined results: a text without words, or a null text, has no set and is linked with nothing; so are rows without an id
(component null); rows that repeat an id are linked by their own texts; an empty table gives an empty table; further
columns are dropped (join them back by the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Unions, components, tidy

WORDS, THRESHOLD = 4, 85
BLOCK, BUCKET_SETS = 1500, 2000
CACHE_WORDS, FANOUT = 80_000, 16

_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _M2
    return (x ^ (x >> _U(29))) * _M1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word)
        if len(word) <= 100:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


_words = _Words()


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; of the whole sequence where there are fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, _U)
    for i in range(size):
        out = _mix(out * _M1 + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    a, b = _mix(tokens ^ _M1).sum(dtype=_U), _mix(tokens + _M2).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def upper(low: int, threshold: int) -> int:
    """The smallest bound such that sizes of the class below ``low`` never pair with it: more than low / threshold."""
    return (low * 100) // threshold + 1


def bounds(most: int, threshold: int = THRESHOLD) -> np.ndarray:
    out = [1]
    while out[-1] <= most:
        out.append(upper(out[-1], threshold))
    return np.array(out, np.int64)


def parts_of(class_: int, edges: np.ndarray, threshold: int) -> tuple[int, int]:
    """(number of parts, Z) for sets of this class and the next one."""
    small = int(edges[class_ + 1]) - 1
    large = small * 100 // threshold
    differ = (100 - threshold) * (small + large) // (100 + threshold)
    if not differ:
        return 1, 0
    spare = 1 + (differ + 1 > 20) + (differ + 1) // 50
    return differ + 1 + spare, spare


def signatures(tokens: np.ndarray, edges: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Hashes of the parts of a set, for its own size class and the one below."""
    own = int(np.searchsorted(edges, len(tokens), "right")) - 1
    out = []
    for class_ in (own, own - 1) if own else (own,):
        parts, spare = parts_of(class_, edges, threshold)
        if parts == 1:
            continue  # only equal sets are similar
        part = ((_mix(tokens + _U(0x5851F42D4C957F2D)) >> _U(32)) * _U(parts)) >> _U(32)
        order = np.argsort(part, kind="stable")
        sums = np.zeros(parts, _U)
        begins = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
        sums[part[order][begins].astype(np.int64)] = np.add.reduceat(_mix(tokens[order] ^ _M2), begins)
        filled = np.zeros(parts, bool)
        filled[part.astype(np.int64)] = True
        if parts - filled.sum() <= spare:
            chosen = np.flatnonzero(filled)
        else:
            chosen = np.arange(parts)
        out.append(_mix(sums[chosen] + _mix(chosen.astype(_U) + _U(class_ << 32))))
    return np.concatenate(out) if out else np.zeros(0, _U)


def map_bits(class_: int, edges: np.ndarray) -> int:
    """Bits of the bitmaps of a size class: twice the most tokens, as a power of two, up to 2 ** 15."""
    return 1 << min(15, max(7, (2 * int(edges[class_ + 1])).bit_length()))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, _U)
    spot = (tokens >> _U(7)) & _U(bits - 1)
    np.bitwise_or.at(out, (spot >> _U(6)).astype(np.int64), _U(1) << (spot & _U(63)))
    return out


def folded(map_: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the set has with fewer bits."""
    while len(map_) > words:
        map_ = map_[: len(map_) // 2] | map_[len(map_) // 2 :]
    return map_


class SignatureTree:
    """Sets by size; level 0 holds the sets, each further one nodes of FANOUT nodes below."""

    def __init__(self, maps: np.ndarray, n: np.ndarray):
        excess = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, n, n, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, least, most, excess = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(excess, at)))

    def possible(self, level: int, a: slice, other: SignatureTree, b: slice, threshold: int) -> np.ndarray:
        """Which pairs of nodes may hold similar sets, by their sizes and their largest possible overlap."""
        maps, least, most, excess = (x[a] for x in self.levels[level])
        maps_, least_, most_, excess_ = (x[b] for x in other.levels[level])
        fits = (100 * most[:, None] >= threshold * least_[None, :]) & (100 * most_[None, :] >= threshold * least[:, None])
        overlap = np.zeros(fits.shape, np.int64)
        i, j = np.nonzero(fits)
        if len(i):
            shared = np.bitwise_count(maps[i] & maps_[j]).sum(axis=1, dtype=np.int64)
            overlap[i, j] = shared + np.minimum(excess[i], excess_[j])
        return fits & ((100 + threshold) * overlap >= threshold * (least[:, None] + least_[None, :]))


def link(maps: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int, unions: Unions, sets: list[np.ndarray] | None = None) -> None:
    """Joins all similar pairs of sets of ``left`` x ``right`` (positions, each by size) that aren't joined yet.

    Without the sets, pairs that their bitmaps can't tell apart are joined.
    """
    same = left is right
    one = SignatureTree(maps[left], n[left])
    two = one if same else SignatureTree(maps[right], n[right])
    while len(one.levels) < len(two.levels):
        one.levels.append(one.levels[-1])
    while len(two.levels) < len(one.levels):
        two.levels.append(two.levels[-1])
    todo = [(len(one.levels) - 1, 0, 0)]
    while todo:
        level, x, y = todo.pop()
        if not level:
            continue
        def below(tree: SignatureTree, node: int) -> slice:
            n = len(tree.levels[level - 1][0])
            return slice(node, node + 1) if n == len(tree.levels[level][0]) else slice(node * FANOUT, min(n, node * FANOUT + FANOUT))
        a, b = below(one, x), below(two, y)
        fits = one.possible(level - 1, a, two, b, threshold)
        i, j = np.nonzero(fits)
        i, j = i + a.start, j + b.start
        if same:
            i, j = i[i <= j], j[i <= j]
        if level > 1:
            todo += [(level - 1, p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True)]
            continue
        roots_a = {p: unions.find(int(left[p])) for p in set(i.tolist())}
        roots_b = {q: unions.find(int(right[q])) for q in set(j.tolist())}
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            u, v = int(left[p]), int(right[q])
            if u == v or roots_a[p] == roots_b[q] or unions.find(u) == unions.find(v):
                continue
            if sets is None:
                unions.join(u, v)
                continue
            s, t = sets[u], sets[v]
            overlap = len(s) + len(t) - len(np.union1d(s, t))
            if 100 * overlap >= threshold * (len(s) + len(t) - overlap):
                unions.join(u, v)


def _tokens_of(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column)


def _light(n_words: int, edges: np.ndarray, threshold: int):
    """Per text: its set's key and size, and the set's size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, maps = [], [], []
            for t in _tokens_of(b.column("data")):
                s = shingles(t, n_words)
                keys.append(set_key(s))
                sizes.append(len(s))
                maps.append(bitmap(s, map_bits(int(np.searchsorted(edges, len(s), "right")) - 1, edges)).astype("<u8").tobytes() if len(s) else b"")
            n = np.array(sizes, np.int64)
            class_ = np.searchsorted(edges, n, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(n), pa.array(class_.astype(np.int32)), pa.array(maps, pa.binary())],
                names=["doc_id", "key1", "key2", "n_shingles", "class", "map"],
            )

    return run


def _signature_rows(n_words: int, edges: np.ndarray, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that meet in a task are given once
        names = ["sig", "key1"]
        for b in batches:
            sigs, keys, held = [], [], 0
            for t in _tokens_of(b.column("data")):
                s = shingles(t, n_words)
                if not len(s) or (key := set_key(s)[0]) in seen:
                    continue
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                seen.add(key)
                found = signatures(s, edges, threshold)
                sigs.append(found)
                keys.append(np.full(len(found), key))
                held += len(found)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=names)
                    sigs, keys, held = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=names)

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (sig, key1): each further key of a signature beside the signature's first one."""
    last_sig, first_key = None, None
    for b in batches:
        if not len(b):
            continue
        sig, key = b.column("sig").to_numpy(), b.column("key1").to_numpy()
        new = np.append(True, sig[1:] != sig[:-1])
        lead = key[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))].copy()
        if last_sig == sig[0]:
            lead[: int(new[1:].argmax()) + 1 if new[1:].any() else len(sig)] = first_key
        last_sig, first_key = sig[-1], lead[-1]
        differs = lead != key
        pairs = np.unique(np.stack([key[differs], lead[differs]], 1), axis=0) if differs.any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _placed(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, key, t, places in zip(b.column("doc_id").to_pylist(), b.column("key1").to_pylist(), _tokens_of(b.column("data")), b.column("places"), strict=True):
                s = shingles(t, n_words)
                if set_key(s)[0] != key:
                    continue
                got = places.as_py()
                rows = len(got)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["bucket"] for p in got], pa.int64()), pa.array([p["grp"] for p in got], pa.int64()), pa.array([p["side"] for p in got], pa.int32()), pa.array([doc_id] * rows, pa.int64()), pa.array([s.astype("<u8").tobytes()] * rows, pa.binary())],
                    names=["bucket", "grp", "side", "doc_id", "tokens"],
                )

    return run


def _narrowed(threshold: int):
    """Rows (grp, side, rep, key1): parts of a group that their bitmaps can't tell apart, two sets or more each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "rep"], kind="stable").reset_index(drop=True)
        grp, side, n = rows.grp.to_numpy(), rows.side.to_numpy(), rows.n.to_numpy()
        part = np.full(len(rows), -1, np.int64)
        for at in np.split(np.arange(len(rows)), np.flatnonzero(grp[1:] != grp[:-1]) + 1):
            if len(at) < 2:
                continue
            held = [np.frombuffer(m, "<u8") for m in rows["map"].iloc[at]]
            words = min(map(len, held))
            unions = _unions(np.stack([folded(m, words) for m in held]), n[at], side[at], threshold, None)
            part[at] = at[[unions.find(i) for i in range(len(at))]]
        several = np.bincount(part[part >= 0], minlength=len(rows)) > 1 if len(rows) else np.zeros(0, bool)
        kept = np.flatnonzero((part >= 0) & several[part])
        # A part has the number of its group and of the set that leads it.
        made = _mix(grp[kept].view(_U) + _mix(rows.rep.to_numpy()[part[kept]].view(_U))).view(np.int64)
        return pd.DataFrame({"grp": made, "side": side[kept], "rep": rows.rep.to_numpy()[kept], "key1": rows.key1.to_numpy()[kept]})

    return run


def _unions(maps: np.ndarray, n: np.ndarray, side: np.ndarray, threshold: int, sets: list[np.ndarray] | None) -> Unions:
    unions = Unions(len(maps))
    by_size = np.lexsort([maps[:, 0], n])
    sides = np.unique(side)
    # Two blocks meet each other; each meets itself in a group of its own.
    left, right = (by_size, by_size) if len(sides) == 1 else (by_size[side[by_size] == s] for s in sides)
    link(maps, n, left, right, threshold, unions, sets)
    return unions


def _linked(threshold: int):
    """Rows (a, b): a set and the smallest one of the task's group that it is joined with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "doc_id"], kind="stable")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, group in rows.groupby("grp", sort=False):
            if len(group) < 2:
                continue
            ids, held = group.doc_id.to_numpy(), [np.frombuffer(t, "<u8") for t in group.tokens]
            n = np.array([len(s) for s in held])
            bits = 1 << int(np.clip(2 * n.max() - 1, 63, (1 << 15) - 1)).bit_length()
            unions = _unions(np.stack([bitmap(s, bits) for s in held]), n, group.side.to_numpy(), threshold, held)
            root = np.array([unions.find(i) for i in range(len(held))])
            moved = root != np.arange(len(held))
            a.append(ids[moved])
            b.append(ids[root[moved]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _large(members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The members, with large set where their group has over BLOCK of them."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = scratch.table(sizes.filter(F.col("n") > BLOCK).select("grp", F.lit(True).alias("large")), name)
    return members.join(large, "grp", "left")


def _split(members: DataFrame) -> DataFrame:
    """Members by size class and by pair of blocks: rep, key1, a task's group and the side of the pair."""
    by_class = members.select("rep", "key1", "grp", F.explode(F.array("class", F.col("class") - 1)).alias("g"))
    blocks = by_class.groupBy("grp", "g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    mine = by_class.join(blocks, ["grp", "g"]).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    return mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "rep", "key1", F.xxhash64("grp", "g", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def _in_buckets(places: DataFrame, size: int) -> DataFrame:
    return places.withColumn("bucket", F.pmod(F.xxhash64("grp", F.lit(3)), F.lit(max(1, -(-places.count() // size)))))


def similar_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row; ``threshold`` in percent."""
    scratch = Scratch(df.sparkSession)
    edges = bounds(1 << 40, threshold)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("data"))
    light = scratch.table(docs.mapInArrow(tidy(_light(n_words, edges, threshold), _words), "doc_id bigint, key1 bigint, key2 bigint, n_shingles bigint, class int, map binary"), "light")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = scratch.table(light.filter(usable).groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("class").alias("class")), "classes")

    sigs = docs.filter("doc_id IS NOT NULL AND data IS NOT NULL").select("data").mapInArrow(tidy(_signature_rows(n_words, edges, threshold), _words), "sig bigint, key1 bigint")
    met = sigs.repartition("sig").sortWithinPartitions("sig", "key1").mapInArrow(tidy(_meetings), "a bigint, b bigint").distinct()
    met = scratch.table(met, "met")
    led = met.select(F.col("a").alias("key1"), F.col("b").alias("grp")).unionAll(met.select(F.col("b").alias("key1"), F.col("b").alias("grp")).distinct())
    members = _large(scratch.table(classes.join(led, "key1").select("rep", "key1", "n_shingles", "class", "grp"), "members"), scratch, "large")
    small = members.filter("large IS NULL").select("rep", "key1", "grp", F.lit(0).alias("side"))
    split = _in_buckets(scratch.table(small.unionAll(_split(members.filter("large"))), "split"), BUCKET_SETS)
    maps = light.filter(usable).select(F.col("doc_id").alias("rep"), "key1", F.col("n_shingles").alias("n"), "map")
    mapped = split.join(maps.join(split.select("rep", "key1").distinct(), ["rep", "key1"]).dropDuplicates(["rep", "key1"]), ["rep", "key1"])
    places = mapped.groupBy("bucket").applyInPandas(_narrowed(threshold), "grp bigint, side int, rep bigint, key1 bigint")
    places = _in_buckets(scratch.table(places, "places"), BUCKET_SETS)
    wanted = places.groupBy("rep", "key1").agg(F.collect_list(F.struct("bucket", "grp", "side")).alias("places")).withColumnRenamed("rep", "doc_id")
    # Never by broadcast: what is wanted grows with the table, and so the plan is the same at every size.
    fetched = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "key1", "data", "places")
    placed = fetched.mapInArrow(tidy(_placed(n_words), _words), "bucket bigint, grp bigint, side int, doc_id bigint, tokens binary")
    links = scratch.table(placed.groupBy("bucket").applyInPandas(_linked(threshold), "a bigint, b bigint"), "links")

    found = components(links, scratch, "found").withColumnRenamed("id", "rep")
    of_class = classes.join(found, "rep", "left").select("key1", "key2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    return light.join(of_class, ["key1", "key2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(usable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
