"""Fingerprints of documents: quartile bucket digests, compared with a bounded difference score.

The byte triplets of every window of five bytes (six choices that hold its first byte) are hashed to 256 buckets and
counted. The counts' quartiles divide the buckets into four classes of two bits each. In front of them stand a byte of a
checksum, a byte of the length on a logarithmic scale and a byte of the quartiles' ratios. Texts are read in pieces of
PIECE bytes, so that memory is bounded by the text itself.

Two digests differ by the sum of their buckets' steps (opposite ends count double), the steps between their lengths and
ratios, and one for the checksum. Independent digests differ by LIMIT on average; likeness is one less the share of it,
0 at least. Equal texts have equal fingerprints, and only equal fingerprints have likeness 1.

Defined results: a null text counts as empty; texts below three bytes have no triplets, only checksum and length; rows
that repeat an id follow each other by a hash of their texts, null ids come first; an empty table gives an empty table;
further columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy

BUCKETS, PIECE = 256, 1 << 20
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Cost of classes that are 0 to 3 apart; of a step of length (a fifth of it) and of ratio, and the most such steps.
CLASS_COST, LENGTH_COST, RATIO_COST, MOST_STEPS = np.array([0, 1, 2, 6]), 4, 2, 12
LIMIT = BUCKETS * 13 / 8


def _counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(whole), PIECE):
        a = whole[begin : begin + PIECE + 4].astype(np.uint32)
        for k, (second, third) in enumerate(TRIPLETS):
            # Windows that begin in the next piece are counted there.
            m = min(len(a) - third, PIECE)
            if m > 0:
                h = (a[:m] | a[second : second + m] << 8 | a[third : third + m] << 16 | np.uint32(k << 24)) * np.uint32(0x9E3779B1)
                h = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
                counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """134 hex digits: checksum, length, ratios, classes."""
    data = text.encode("utf-8", "surrogatepass")
    counts = _counts(data)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    classes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = classes.reshape(-1, 4) @ np.array([1, 4, 16, 64])
    length = min(255, int(4 * np.log2(len(data) + 1)))
    ratios = 15 * q1 // q3 << 4 | 15 * q2 // q3 if q3 else 0
    return bytes([zlib.crc32(data) & 255, length, ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


def _classes(packed: bytes) -> np.ndarray:
    return (np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6]) & 3).ravel().astype(np.int64)


def likeness_of(a: str, b: str) -> float:
    """1 for equal digests, 0 for those that differ by LIMIT or more."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    differ = int(CLASS_COST[np.abs(_classes(x[3:]) - _classes(y[3:]))].sum())
    differ += LENGTH_COST * min(MOST_STEPS, abs(x[1] - y[1])) + (x[0] != y[0])
    differ += RATIO_COST * min(MOST_STEPS, abs((x[2] >> 4) - (y[2] >> 4)) + abs((x[2] & 15) - (y[2] & 15)))
    return max(0.0, 1 - differ / LIMIT)


def fingerprint(text: Column) -> Column:
    """string: the digest of a text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([digest(t.as_py() or "") for t in texts], pa.string())

    return F.arrow_udf(run, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """double: the likeness of two digests; null where one is null."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else likeness_of(x, y) for x, y in pairs], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


#: A judged row; at a range's ends ``edge`` tells its first text and the row that still wants the next one.
_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_EDGES = pa.schema([*_ROW, ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())])
_NAMES = [name for name, _ in _ROW]
_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _judge(doc_id, text: str, own: str, following: str, theirs: str) -> tuple:
    edited = edited_text(text, following)
    changed = digest(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own, changed, likeness_of(own, changed), likeness_of(own, theirs)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges each row of a sorted range with the row behind it."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_id, text = doc_id.as_py(), text.as_py()
            own = digest(text)
            if held is None:
                rows.append((None, None, None, own, None, None, None, part, "first", text))
            else:
                rows.append((*_judge(*held, text, own), None, None, None))
            held = doc_id, text, own
        yield _batch(rows, _EDGES)
    if held is not None:
        doc_id, text, own = held
        yield _batch([(doc_id, None, None, own, None, None, None, part, "last", text)], _EDGES)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_judge(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.schema(_ROW))


def edited_neighbours(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    Texts are shuffled once, into ranges of their order; neighbours within a range meet there, and the two texts at each
    end of a range are joined to those of the ranges beside it.
    """
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ranges = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    made = scratch.table(ranges.mapInArrow(tidy(_along), f"{_DDL}, part bigint, edge string, text string"), "judged")
    first = made.filter("edge = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    last = made.filter("edge = 'last'").select("part", "doc_id", "text", "fingerprint")
    # One row a range goes through this window, without its text; behind the last range comes the first one.
    line = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    ends = last.join(line, "part").drop("part").join(first.withColumnRenamed("part", "next"), "next")
    ends = ends.select("doc_id", "text", "fingerprint", "following", "theirs").mapInArrow(tidy(_across), _DDL)
    return made.filter("edge IS NULL").select(*_NAMES).unionByName(ends)
