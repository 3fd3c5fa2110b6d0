"""Exact removal of repeated passages by hash-compared suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller id, or at an
earlier place of the same one. Strings never cross documents and are judged on the input.

1. Texts that equal one of a smaller id go as a whole; only the first of each takes part in what follows.
2. Every string of LENGTH bytes has an anchor: its run of K bytes with the smallest hash, the leftmost one on ties. Equal
   strings have equal anchors at equal places, so that strings need comparing only where anchors meet. One shuffle of
   anchor hashes, read in order as a stream, finds those that occur twice.
3. Texts with such anchors are fetched once, and cut into segments: the strings in a row that share an anchor. Equal
   segments are one, of the smallest place.
4. Segments are dealt by anchor. In a task, the strings that have an anchor in the same place are suffixes to sort:
   mergesort, with comparisons through the longest common extension, found by binary search over prefix polynomial
   hashes. All neighbours in the order are then compared byte by byte; a collision sends the strings of the task to a
   plain sort. Of equal strings the first in place stays. Anchors with over HOT distinct segments (a common phrase in
   many contexts) are dealt anew: their segments are cut into blocks of WIDTHS strings, counted from the anchor, and
   dealt by the bytes that all strings of a block share. Equal blocks are one again, so that what lies within a common
   passage shrinks to a row and what reaches into its contexts parts company. All of it is sorted and verified alike.

Defined results: a null text is empty; a row without an id is compared with nothing and keeps all; rows that repeat an
id and a text are one document and get the same result; texts that share an id aren't earlier than one another at the
same place; an empty table gives an empty table; further columns are dropped (join them back by the id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, tidy

LENGTH, K = 100, 40
HOT, BUCKET_SEGMENTS, BLOCK = 128, 4_000, 1 << 20
#: Strings a block, at each time that hot groups are dealt anew; with one string a block, a group's segments are equal.
WIDTHS = (8, 1)

_U = np.uint64
_SPANS = "array<struct<start:int,end:int>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)


def _run_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    x = data.astype(_U)
    for shift in (1, 2, 4):
        x = x[:-shift] | x[shift:] << _U(8 * shift)
    n = len(data) - K + 1
    h = _mixed(x[:n])
    for at in range(8, K, 8):
        h = _mixed(h ^ x[at : at + n])
    return h


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each string of the bytes (at most BLOCK of them) the place of its anchor; and the runs' hashes."""
    hashes = _run_hashes(data)
    key = (hashes & _U(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=_U)
    width, size = length - K + 1, 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key & _U(0xFFFFFF)).astype(np.int64), hashes


def segments(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, start, number of strings, anchor's hash) of all segments; texts are looked through in blocks."""
    block: list[tuple[int, int, bytes]] = []
    held = 0

    def cut() -> tuple:
        sizes = np.array([len(p) for *_, p in block])
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"".join(p for *_, p in block), np.uint8)
        at, hashes = anchors(data, length)
        inside = np.zeros(len(at), bool)
        begins = stops - sizes
        for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
            inside[b : e - length + 1] = True
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        new[begins] = True
        starts = np.flatnonzero(new & inside)
        piece = np.searchsorted(stops, starts, "right")
        ends = np.append(starts[1:], len(at))
        ends = np.minimum(ends, (stops - length + 1)[piece])
        number = np.array([i for i, *_ in block])[piece]
        offset = np.array([o for _, o, _ in block])[piece]
        return number, starts - begins[piece] + offset, ends - starts, hashes[at[starts]].view(np.int64)

    for i, text in enumerate(texts):
        for o in range(0, max(1, len(text) - length + 1), BLOCK - length + 1):
            piece = text[o : o + BLOCK]
            if len(piece) < length:
                continue
            if held + len(piece) > BLOCK:
                yield cut()
                block, held = [], 0
            block.append((i, o, piece))
            held += len(piece)
    if block:
        yield cut()


def _by_text(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, starts, sizes, hashes) of each text that has segments."""
    held: list[tuple] = []
    for number, start, size, h in segments(texts, length):
        edges = np.flatnonzero(np.diff(number)) + 1
        for part in zip(np.split(number, edges), np.split(start, edges), np.split(size, edges), np.split(h, edges), strict=True):
            if held and held[0][0][0] != part[0][0]:
                yield int(held[0][0][0]), *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
                held = []
            held.append(part)
    if held:
        yield int(held[0][0][0]), *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB of that column."""
    for b in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)])
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > 4 * BLOCK:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(b):
            yield b.slice(begin)


def _anchor_rows(length: int):
    """(mark, text_key): an anchor's hash, of which the lowest bit tells that the text has it in several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "data"):
            keys = b.column("text_key").to_numpy()
            marks, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, _, _, h in _by_text(b.column("data").to_pylist(), length):
                found, n = np.unique(h & ~np.int64(1), return_counts=True)
                marks.append(found | (n > 1))
                owners.append(np.full(len(found), keys[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks)), pa.array(np.concatenate(owners))], names=["mark", "text_key"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (mark, text_key): (hash, text_key), once each, of hashes with several texts or places."""
    last_hash, last_key, many = None, None, False
    for b in batches:
        if not len(b):
            continue
        mark, key = b.column("mark").to_numpy(), b.column("text_key").to_numpy()
        h = mark & ~np.int64(1)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.cumsum(new) - 1
        n_runs = run[-1] + 1
        several = np.zeros(n_runs, bool)
        several[run[(mark & 1) == 1]] = True
        differs = np.flatnonzero(~new[1:] & (key[1:] != key[:-1])) + 1
        several[run[differs]] = True
        goes_on = last_hash is not None and h[0] == last_hash
        if goes_on:
            several[0] |= many or key[0] != last_key
        fresh = new.copy()
        fresh[1:] |= key[1:] != key[:-1]
        if goes_on and key[0] == last_key:
            fresh[0] = False
        out_h, out_k = h[fresh & several[run]], key[fresh & several[run]]
        if goes_on and several[0] and not many:  # the row that was held back
            out_h, out_k = np.append(out_h, last_hash), np.append(out_k, last_key)
        many = bool(several[-1])
        last_hash, last_key = int(h[-1]), int(key[-1])
        yield pa.RecordBatch.from_arrays([pa.array(out_h), pa.array(out_k)], names=["hash", "text_key"])


def _windows(length: int):
    """Adds to each text the runs of its strings that have a repeated anchor, and drops texts without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "data"):
            hashes = b.column("hashes")
            rows, cuts = [], []
            for i, start, size, h in _by_text(b.column("data").to_pylist(), length):
                held = np.isin(h & ~np.int64(1), hashes[i].values.to_numpy())
                if held.any():
                    rows.append(i)
                    cuts.append(np.stack([start[held], size[held], h[held] & ~np.int64(1)]).astype("<i8").tobytes())
            taken = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([taken.column("doc_id"), taken.column("text_key"), taken.column("data"), pa.array(cuts, pa.binary())], names=["doc_id", "text_key", "data", "cuts"])

    return run


def _cut_out(length: int):
    """The segments' bytes; equal ones of a text are given once, the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "data"):
            for doc_id, data, cuts in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                start, size, h = np.frombuffer(cuts, "<i8").reshape(3, -1)
                for at in range(0, len(start), 20_000):
                    first: dict[bytes, int] = {}
                    for i, (s, m) in enumerate(zip(start[at : at + 20_000].tolist(), size[at : at + 20_000].tolist(), strict=True), at):
                        first.setdefault(data[s : s + m + length - 1], i)
                    chosen = np.fromiter(first.values(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[chosen]), pa.array(list(first), pa.binary()), pa.array([doc_id] * len(chosen), pa.int64()), pa.array(start[chosen])],
                        names=["hash", "data", "doc_id", "start"],
                    )

    return run


def _blocks(length: int, width: int):
    """Cuts segments into blocks of ``width`` strings, counted from the anchor; ``hash`` is of the bytes that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "data"):
            hashes, datas, docs, starts = [], [], [], []
            given = b.column("data").to_pylist()
            behind = _anchor_of_first(given, length) if given else ()
            for h, data, doc_id, start, first in zip(b.column("hash").to_pylist(), given, b.column("doc_id").to_pylist(), b.column("start").to_pylist(), behind, strict=True):
                # String i starts first - i bytes before the anchor; block k holds those from k * width on.
                n = len(data) - length + 1
                for k in range((first - n + 1) // width, first // width + 1):
                    low, high = max(0, first - k * width - width + 1), min(n - 1, first - k * width)
                    core = first - k * width
                    shared = data[core : core - width + 1 + length]
                    hashes.append(xxhash.xxh64_intdigest(shared, (h ^ k) & 0xFFFFFFFF) >> 1)
                    datas.append(data[low : high + length])
                    docs.append(doc_id)
                    starts.append(start + low)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(datas, pa.binary()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64())], names=["hash", "data", "doc_id", "start"])

    return run


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    np.cumprod(np.full(n - 1, 0x9E3779B97F4A7C15, _U), out=out[1:])
    return out


class Suffixes:
    """Strings of ``length`` bytes within some data, compared through prefix polynomial hashes."""

    def __init__(self, data: bytes, length: int):
        self.data, self.length = np.frombuffer(data, np.uint8), length
        self.powers = _powers(1 << max(16, (len(data) + 1).bit_length()))
        self.prefix = np.zeros(len(data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * self.powers[: len(data)], out=self.prefix[1:])

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        low, high = np.minimum(a, b), np.maximum(a, b)
        return (self.prefix[low + n] - self.prefix[low]) * self.powers[high - low] == self.prefix[high + n] - self.prefix[high]

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair: binary search for the longest common extension, then the bytes behind it."""
        out = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(~self.same(a, b, self.length))
        x, y = a[differ], b[differ]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length - 1)
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.same(x, y, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        out[differ] = np.where(self.data[x + low] < self.data[y + low], -1, 1)
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the strings within their groups (equal numbers stand together), by merging runs of twice the size each time."""
        order = np.arange(len(at))
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(begins, len(at)))
        begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < (sizes.max() if len(sizes) else 0):
            live = np.flatnonzero(size > width)
            local = live - begin[live]
            pair = local // (2 * width) * (2 * width)
            right = local - pair >= width
            other = np.where(right, pair, pair + width)
            low, high = np.zeros(len(live), np.int64), np.clip(size[live] - other, 0, width)
            mine = at[order[live]]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) >> 1
                there = at[order[begin[live[open_]] + other[open_] + middle]]
                sign = self.order(there, mine[open_])
                before = np.where(right[open_], sign <= 0, sign < 0)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = begin[live] + pair + (local - pair - np.where(right, width, 0)) + low
            merged = order.copy()
            merged[place] = order[live]
            order = merged
            width *= 2
        return order

    def strings(self, at: np.ndarray) -> np.ndarray:
        """The strings themselves, as rows of big-endian words, padded."""
        out = np.zeros((len(at), -(-self.length // 8) * 8), np.uint8)
        out[:, : self.length] = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[at]
        return out.view(">u8")


def equal_strings(data: bytes, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings in which equal ones of a group are neighbours, and where each class begins."""
    suffixes = Suffixes(data, length)
    order = suffixes.sort(at, group)
    new = np.ones(len(order), bool)
    sound = True
    for i in range(1, len(order), 20_000):
        a, b = order[i - 1 : i + 20_000 - 1], order[i : i + 20_000]
        a = a[: len(b)]
        together = group[a] == group[b]
        x, y = suffixes.strings(at[a]), suffixes.strings(at[b])
        differ = x != y
        first = differ.argmax(axis=1)
        rows = np.arange(len(b))
        any_ = differ[rows, first]
        sound &= not (together & any_ & (x[rows, first] > y[rows, first])).any()
        new[i : i + len(b)] = ~together | any_
    if not sound:  # a hash collision misled a comparison
        words = suffixes.strings(at)
        order = np.lexsort([*words.T[::-1], group])
        new = np.append(True, (group[order][1:] != group[order][:-1]) | (words[order][1:] != words[order][:-1]).any(axis=1)) if len(order) else new
    return order, new


def _firsts(length: int):
    """Runs (doc_id, start, n) of the strings of a bucket that no earlier string equals."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        datas, doc, start = rows["data"].tolist(), rows.doc_id.to_numpy(), rows.start.to_numpy()
        sizes = np.array([len(d) for d in datas])
        count = sizes - length + 1
        segment = np.repeat(np.arange(len(datas)), count)
        within = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(sizes) - sizes, count) + within
        data = b"".join(datas)
        # How far behind the string's start its anchor lies tells strings of an anchor apart.
        behind = _anchor_of_first(datas, length)[segment] - within
        by = np.lexsort([behind, rows["hash"].to_numpy()[segment]])
        h, l_ = rows["hash"].to_numpy()[segment][by], behind[by]
        group = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (l_[1:] != l_[:-1])))
        alone = np.bincount(group)[group] == 1
        is_first = np.zeros(len(segment), bool)
        is_first[by[alone]] = True
        by, group = by[~alone], group[~alone]
        if len(by):
            order, new = equal_strings(data, at[by], group, length)
            item = by[order]
            class_ = np.cumsum(new)
            rank = np.lexsort([start[segment[item]] + within[item], doc[segment[item]], class_])
            lead = np.append(True, class_[rank][1:] != class_[rank][:-1])
            is_first[item[rank[lead]]] = True
            # Places that tie with the first one are first as well.
            leads = np.maximum.accumulate(np.where(lead, np.arange(len(rank)), 0))
            a, b = item[rank], item[rank[leads]]
            tied = (doc[segment[a]] == doc[segment[b]]) & (start[segment[a]] + within[a] == start[segment[b]] + within[b])
            is_first[a[tied]] = True
        begins = is_first & np.append(True, ~is_first[:-1] | (segment[1:] != segment[:-1]))
        spots = np.flatnonzero(begins)
        n = np.add.reduceat(is_first.astype(np.int64), spots) if len(spots) else np.zeros(0, np.int64)
        return pd.DataFrame({"doc_id": doc[segment[spots]], "start": start[segment[spots]] + within[spots], "n": n})

    return run


def _anchor_of_first(datas: list[bytes], length: int) -> np.ndarray:
    """Place of the anchor of each segment's first string."""
    heads = np.frombuffer(b"".join(d[:length] for d in datas), np.uint8)
    out = []
    for at in range(0, len(datas), 10_000):
        part = heads[at * length : (at + 10_000) * length]
        place, _ = anchors(part, length)
        out.append(place[::length] - np.arange(0, len(part), length))
    return np.concatenate(out)


def _remove(length: int):
    """spans, n_removed and the hash of what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "data"):
            out = []
            for data, cuts, firsts in zip(b.column("data").to_pylist(), b.column("cuts").to_pylist(), b.column("firsts").to_pylist(), strict=True):
                start, size, _ = np.frombuffer(cuts, "<i8").reshape(3, -1)
                change = np.zeros(len(data) + 2, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + size, -1)
                repeated = np.cumsum(change) > 0
                for f in firsts or ():
                    repeated[f["start"] : f["start"] + f["n"]] = False
                covered = np.zeros(len(data) + 2, np.int32)
                edge = np.diff(np.append(False, repeated).astype(np.int8))
                begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                covered[begins] += 1
                np.add.at(covered, np.minimum(ends + length - 1, len(data)), -1)
                gone = np.cumsum(covered)[: len(data)] > 0
                edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                out.append((spans, int(gone.sum()), hashlib.sha256(left).hexdigest()))
            spans, removed, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "text_key", "spans", "n_removed", "kept_sha256"],
            )

    return run


def find_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, text_key, n_bytes, n_removed, spans (removed byte ranges) and kept_sha256 of every row.

    text_key is xxhash64 of the text, to join the spans back to rows whose ids repeat.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    docs = docs.withColumn("text_key", F.xxhash64("data"))
    light = docs.select("doc_id", "text_key", F.xxhash64(F.lit(1), "data").alias("key2"), F.octet_length("data").cast("bigint").alias("n_bytes"), F.sha2("data", 256).alias("own_sha256"))
    light = scratch.table(light, "light")
    firsts_of = light.filter("doc_id IS NOT NULL").groupBy("text_key", "key2").agg(F.min("doc_id").alias("first_id"))
    firsts_of = scratch.table(firsts_of, "texts")

    marks = docs.filter("doc_id IS NOT NULL").select("text_key", "data").mapInArrow(tidy(_anchor_rows(length)), "mark bigint, text_key bigint")
    # Both marks of a hash meet in a partition: the lowest bit takes no part in the dealing.
    dealt = marks.repartition(F.shiftright("mark", 1)).sortWithinPartitions(F.shiftright("mark", 1), "text_key")
    repeated = scratch.table(dealt.mapInArrow(tidy(_repeated), "hash bigint, text_key bigint"), "repeated")
    held = repeated.groupBy("text_key").agg(F.collect_list("hash").alias("hashes")).join(firsts_of, "text_key").select(F.col("first_id").alias("doc_id"), "text_key", "hashes")
    fetched = docs.join(held, ["doc_id", "text_key"])
    texts = scratch.table(fetched.select("doc_id", "text_key", "data", "hashes").mapInArrow(tidy(_windows(length)), "doc_id bigint, text_key bigint, data binary, cuts binary"), "cut")
    scratch.drop("repeated")

    # The place (id, start) as one number, which partial aggregation keeps in order.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("start").cast("decimal(11,0)")
    unpacked = [F.expr("(place - pmod(place, 2147483648bd)) div 2147483648bd").alias("doc_id"), F.expr("cast(pmod(place, 2147483648bd) AS bigint)").alias("start")]
    schema = "hash bigint, data binary, doc_id bigint, start bigint"

    def distinct(cut: DataFrame, name: str) -> DataFrame:
        return scratch.table(cut.groupBy("hash", "data").agg(F.min(place.cast("decimal(38,0)")).alias("place")), name)

    cut = distinct(texts.select("doc_id", "data", "cuts").mapInArrow(tidy(_cut_out(length)), schema), "segments")
    held, cool = cut, []
    for width in WIDTHS:
        counts = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        hot = scratch.table(counts.filter(F.col("n") > HOT).select("hash", F.lit(True).alias("hot")), f"hot-{width}")
        flagged = held.join(hot, "hash", "left").select("hash", "data", *unpacked, "hot")
        cool.append(flagged.filter("hot IS NULL").drop("hot"))
        held = distinct(flagged.filter("hot").drop("hot").mapInArrow(tidy(_blocks(length, width)), schema), f"blocks-{width}")
    cool.append(held.select("hash", "data", *unpacked))
    buckets = max(1, -(-cut.count() // BUCKET_SEGMENTS))
    dealt = reduce(DataFrame.unionAll, cool).withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    firsts = dealt.groupBy("bucket").applyInPandas(_firsts(length), "doc_id bigint, start bigint, n bigint")
    by_text = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    removed = texts.join(by_text, "doc_id", "left").select("doc_id", "text_key", "data", "cuts", "firsts").mapInArrow(
        tidy(_remove(length)), f"doc_id bigint, text_key bigint, spans {_SPANS}, n_removed bigint, kept_sha256 string"
    )
    removed = scratch.table(removed, "removed").dropDuplicates(["doc_id", "text_key"])

    copy = F.col("doc_id").isNotNull() & (F.col("first_id") < F.col("doc_id")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    return (
        light.join(firsts_of, ["text_key", "key2"], "left").join(removed, ["doc_id", "text_key"], "left")
        .select(
            "doc_id", "text_key", "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        )
    )


def strip(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the found spans cut from their texts; characters that a cut halves go. Texts stay null where null."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and s:
                data, at, kept = t.encode(), 0, []
                for x in s:
                    kept.append(data[at : x["start"]].decode("utf-8", "ignore"))
                    at = x["end"]
                t = "".join(kept) + data[at:].decode("utf-8", "ignore")
            out.append(t)
        return pa.array(out, pa.string())

    key, id_, cut = fresh(df.columns, "_key", "_id", "_spans")
    keyed = df.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    cuts = found.filter("n_removed > 0").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("spans").alias(cut)).dropDuplicates([id_, key])
    joined = keyed.join(cuts, (F.col(doc_id).cast("bigint") == F.col(id_)) & (keyed[key] == cuts[key]), "left")
    return joined.withColumn(text, F.arrow_udf(run, "string")(F.col(text), F.col(cut))).select(*df.columns)
