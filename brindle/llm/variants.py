"""Spelling variants of a corpus by full neighbourhood generation.

Words are counted with partial sums. Each word of the vocabulary then emits its whole neighbourhood: all distinct texts
with one code point deleted, replaced or inserted, over the alphabet that the vocabulary shows. A neighbour that is a word
is near by construction, so that a hash join with the vocabulary by the text itself gives the near words, without a
distance to verify. The links from words to forms are followed by doubling.

A word of ten letters has some twelve hundred neighbours, of which hardly any is a word. They are made as 64-bit hashes,
by array operations from hashes of a word's beginnings and ends, and looked up in a bitmap of the vocabulary's hashes
(one bit a word, 32 bits a word or more, 2^30 bits at most, which bounds what is broadcast). Only those whose bit is set
are written out as texts and joined; others can't be in the vocabulary. Beyond 2^25 words the bitmap fills, so that more
texts are joined in vain; the rows stay the same.

Defined results: null texts have no words; a null id counts as the empty text in the hash that plants typing errors;
repeated rows count as often as they stand there; ties of the largest count go to the smallest word in code-point order;
an empty table has no words; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR, PLANTED = 6, 5, 5, 199
#: Maximal runs of these are words; shorter runs can't give a word, with or without a deletion.
LETTERS = "[A-Za-zÀ-ÿ]"
BITS_PER_WORD, MOST_BITS = 32, 30
#: An odd multiplier of the polynomial hash, and of the last mixing step.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BITMAP_BUCKET = 32768
#: Neighbours that are held at once.
AT_ONCE = 2_000_000


def planted_errors(doc_id: Column, run: Column) -> Column:
    """The run without one code point where the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % PLANTED == 0, cut).otherwise(run)


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = df.select(F.col(doc_id).alias("_of"), F.explode(found).alias("_run")).withColumn("_run", F.translate("_run", upper, upper.lower()))
    words = runs.select(planted_errors(F.col("_of"), F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE, np.uint64))), dtype=np.uint64)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each hash; the high bits of a product depend on all of it."""
    h = hashes ^ (hashes >> np.uint64(32))
    return (h * np.uint64(MIX)) >> np.uint64(64 - bits)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """The sum of each code point times a power of BASE by its place."""
    return (points * _powers(points.shape[1])[: points.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbour_hashes(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
    """(kind, place, hashes by word and, but for deletions, by letter) of all neighbours of words of one length."""
    n, length = points.shape
    power = _powers(length + 1)
    terms = points * power[:length]
    whole = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    # Behind a deletion, places fall by one: their terms are taken with the powers before.
    lower = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(points[:, 1:] * power[: length - 1], axis=1, dtype=np.uint64)], axis=1)
    upper = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(points * power[1 : length + 1], axis=1, dtype=np.uint64)], axis=1)
    for i in range(length):
        yield "delete", i, whole[:, i] + lower[:, -1] - lower[:, i]
        rest = whole[:, -1] - terms[:, i]
        yield "replace", i, rest[:, None] + alphabet[None, :] * power[i]
    for i in range(length + 1):
        rest = whole[:, i] + upper[:, -1] - upper[:, i]
        yield "insert", i, rest[:, None] + alphabet[None, :] * power[i]


def _by_length(words: list[str]) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    yield from groups.values()


def _hash_places(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = np.zeros(len(words), np.uint64)
            for members in _by_length(words):
                out[members] = _places(word_hashes(_points([words[k] for k in members], len(words[members[0]]))), bits)
            yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int64))], ["place"])

    return tidy(run)


def _neighbours(alphabet: str, bitmap, bits: int):
    """Each word with those of its neighbours whose bit is set, as texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _points([alphabet], len(alphabet))[0] if alphabet else np.zeros(0, np.uint64)
        held = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for members in _by_length(words):
                step = max(1, AT_ONCE // max(1, len(letters)))
                for begin in range(0, len(members), step):
                    few = members[begin : begin + step]
                    found: set[tuple[int, str]] = set()
                    for kind, i, hashes in neighbour_hashes(_points([words[k] for k in few], len(words[few[0]])), letters):
                        at = _places(hashes, bits)
                        hits = np.nonzero(held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                        for row, letter in zip(hits[0].tolist(), (hits[1] if hashes.ndim == 2 else hits[0]).tolist(), strict=True):
                            w = words[few[row]]
                            middle = "" if kind == "delete" else alphabet[letter]
                            other = w[:i] + middle + w[i + (kind != "insert") :]
                            if other != w:
                                found.add((few[row], other))
                    rows = sorted(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[k] for k, _ in rows], pa.string()), pa.array([counts[k] for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["word", "n", "neighbour"]
                    )

    return tidy(run)


def _bitmap(words: DataFrame, bits: int) -> bytearray:
    """2^bits bits, of which the words' are set: put together in buckets by Spark, then side by side here."""
    places = words.select("word").mapInArrow(_hash_places(bits), "place bigint")
    # Spark's bit positions count from 1 in a bucket; shifting all places by one keeps bucket and bit in step.
    p = F.col("place") + 1
    buckets = places.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("held"))
    out = bytearray(max(BITMAP_BUCKET, 1 << bits) // 8)
    for r in buckets.toLocalIterator():
        at = (r.bucket - 1) * BITMAP_BUCKET // 8
        out[at : at + len(r.held)] = r.held
    return out


def near_words(words: DataFrame, sc: SparkContext, scratch: Scratch) -> DataFrame:
    """(word, n, near, near_n): each pair of near words, from both sides. ``words``: word, n; a stored table."""
    size = words.count()
    bits = min(MOST_BITS, max(15, (size * BITS_PER_WORD - 1).bit_length()))
    # At most 90 code points: LETTERS has no more, once A-Z are lower case.
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    alphabet = "".join(sorted(r.c for r in letters if r.c))
    held = sc.broadcast(bytes(_bitmap(words, bits)))
    spread = words.repartition(max(1, -(-size // 20_000), sc.defaultParallelism)) if size else words
    made = spread.mapInArrow(_neighbours(alphabet, held, bits), "word string, n bigint, neighbour string")
    found = made.join(words.select(F.col("word").alias("neighbour"), F.col("n").alias("near_n")), "neighbour")
    return scratch.table(found.select("word", "n", F.col("neighbour").alias("near"), "near_n"), "near")


def follow(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of each word with a form: links (word, form) without cycles, followed by doubling to the last."""
    at = scratch.table(links.select("word", F.col("form").alias("root")), "roots-0")
    number = 0
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        number += 1
        nearer = scratch.table(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{number}")
        at = nearer.drop("moved")
        if nearer.filter("moved").isEmpty():
            return at


def variants(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", factor: int = FORM_FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    words = scratch.table(vocabulary(df, doc_id, text), "words")
    near = near_words(words, df.sparkSession.sparkContext, scratch)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    per_word = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(per_word, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less")))
    told = scratch.table(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "forms")
    roots = follow(told.filter("form IS NOT NULL"), scratch)
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
