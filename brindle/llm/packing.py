"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

Two rows of one duplicate cluster never share a bin, and a bin holds at most ``per_source`` rows of one source.
Rows get a number each, which is written with their lengths and keys, and are dealt by its hash to groups of about
``GROUP_ROWS`` rows, each packed by one task: any key, also one that holds a third of all rows, and rows that repeat
without end spread evenly, and a task holds lengths and keys only, no texts. Within a
group, best-fit decreasing: open bins are ordered by residual capacity; the search begins at the first residual that
fits and goes on to its successors until a bin admits the row, which is the tightest compatible bin. Bins carry
bitmaps of the duplicate clusters they hold and, as planes of a unary counter, of their sources.

Texts longer than a bin are cut into pieces of a full bin each and a remainder, which is packed like any other row.

Defined results: a null or blank text has no words, takes no room and gets no bin (bin_id null); a null source or
cluster conflicts with nothing; repeated rows are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY, PER_SOURCE, GROUP_ROWS = 4096, 4, 2000

PACKED = "doc_id bigint, piece int, first_word bigint, n_words bigint, bin_group bigint, bin_no int, bin_words bigint"


class Bins:
    """Open bins, ordered by residual; each with its cluster bitmap and its planes of source bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.planes: list[list[int]] = []

    def add(self, length: int, cluster_bit: int, source_bit: int) -> int:
        """Places a row in the tightest compatible bin, or a new one, and returns the bin's number."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, bin_no = self.order[at]
            if not self.clusters[bin_no] & cluster_bit and not self.planes[bin_no][-1] & source_bit:
                del self.order[at]
                break
            at += 1
        else:
            residual, bin_no = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.planes.append([0] * self.per_source)
        self.clusters[bin_no] |= cluster_bit
        carry = source_bit
        for j, plane in enumerate(self.planes[bin_no]):
            self.planes[bin_no][j], carry = plane | carry, plane & carry
        insort(self.order, (residual - length, bin_no))
        return bin_no


def pack_rows(lengths: list[int], clusters: list, sources: list, capacity: int, per_source: int) -> list[int]:
    """Bin numbers of rows that come longest first; only keys that occur twice or more need bits."""
    bits = []
    for keys in (clusters, sources):
        seen = Counter(k for k in keys if k is not None)
        bits.append({k: 1 << i for i, k in enumerate(k for k, n in seen.items() if n > 1)})
    bins = Bins(capacity, per_source)
    return [bins.add(n, bits[0].get(c, 0), bits[1].get(s, 0)) for n, c, s in zip(lengths, clusters, sources, strict=True)]


def _pack_group(capacity: int, per_source: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        for r in rows.itertuples():
            doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
            full, rest = divmod(int(r.n), capacity)
            pieces += [(capacity, doc_id, p, p * capacity, r.cluster, r.source) for p in range(full)]
            if rest or not full:
                pieces.append((rest, doc_id, full, full * capacity, r.cluster, r.source))
        pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], p[4] or "", p[5] or ""))
        real = [p for p in pieces if p[0]]
        places = pack_rows([p[0] for p in real], [p[4] for p in real], [p[5] for p in real], capacity, per_source)
        held: Counter = Counter()
        for p, b in zip(real, places, strict=True):
            held[b] += p[0]
        group = int(rows.bin_group.iloc[0])
        out = [(p[1], p[2], p[3], p[0], group, b, held[b]) for p, b in zip(real, places, strict=True)]
        out += [(p[1], p[2], p[3], 0, group, None, None) for p in pieces if not p[0]]
        made = pd.DataFrame(out, columns=["doc_id", "piece", "first_word", "n_words", "bin_group", "bin_no", "bin_words"])
        return made.astype({"doc_id": "Int64", "bin_no": "Int32", "bin_words": "Int64"})

    return pack


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word and n_words of the piece, bin_id (string) and bin_words.

    ``cluster`` names a column of duplicate clusters; without it, texts with the same words are a cluster.
    """
    blank = "' \\t\\n\\u000b\\u000c\\r'"
    body = f"trim(BOTH {blank} FROM coalesce(`{text}`, ''))"
    words = f"split({body}, '[ \\\\t-\\\\r]+')"
    key = F.col(cluster).cast("string") if cluster else F.expr(f"CASE WHEN {body} != '' THEN sha2(lower(regexp_replace({body}, '[ \\\\t-\\\\r]+', ' ')), 256) END")
    light = df.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.expr(f"CASE WHEN {body} = '' THEN 0L ELSE cast(size({words}) AS bigint) END").alias("n"),
        F.col(source).cast("string").alias("source"),
        key.alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
    )
    light = Scratch(df.sparkSession).table(light, "light")
    groups = max(1, -(-light.count() // group_rows))
    light = light.withColumn("bin_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = light.groupBy("bin_group").applyInPandas(_pack_group(capacity, per_source), PACKED)
    return packed.select(
        "doc_id", "piece", "first_word", "n_words",
        F.when(F.col("bin_no").isNotNull(), F.concat_ws("-", "bin_group", "bin_no")).alias("bin_id"), "bin_words",
    )
