"""Line diffs of many pairs of texts at once.

Lines that stand once in either text are anchors, found by sorting the lines of both; the longest increasing subsequence of an
anchor's places gives the spine. Between neighbouring anchors of the spine lie gaps; a shortest edit is sought in those that have lines
of both texts. Hunks are window sums along a script: which lines are near a change, the hunks they form and their places.

A text's lines are its own group, which a row's size bounds. A null text counts as empty; line ends of any kind are equal; a last
line without an end is a line like the others; an empty text has none. Gaps that differ by more than MOST_EDITS lines are
replaced as a whole, which is right, though not shortest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_EDITS = 400
LINE_END = "\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"


def cut_lines(text: Column) -> Column:
    """array<string>: the lines of a text."""
    cut = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)


def increasing(places: list[int]) -> list[int]:
    """The numbers of a longest strictly increasing subsequence."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, p in enumerate(places):
        at = bisect_left(ends, p)
        before.append(last[at - 1] if at else -1)
        if at == len(ends):
            ends.append(p)
            last.append(k)
        else:
            ends[at], last[at] = p, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def common_lines(a: list[str], b: list[str], most: int = MOST_EDITS) -> list[tuple[int, int]]:
    """The places of the lines that a shortest edit keeps; none if it has more than ``most`` deletions and insertions."""
    n, m = len(a), len(b)
    reach = {1: 0}
    trace: list[dict[int, int]] = []
    for d in range(min(n + m, most) + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return _walked(trace, n, m)
    return []


def _walked(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else k - 1
        bx = reach[before] if d else 0
        by = bx - before if d else 0
        while x > bx and y > by:
            x, y = x - 1, y - 1
            out.append((x, y))
        x, y = bx, by
    return out[::-1]


def kept_places(a: list[str], b: list[str], anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of the lines that a text keeps: the spine of its anchors, and those of a shortest edit in each gap that has lines of both texts."""
    out, i, j = [], 0, 0
    spine = [anchors[k] for k in increasing([y for _, y in anchors])]
    for ni, nj in [*spine, (len(a), len(b))]:
        if i < ni and j < nj:
            out += [(i + x, j + y) for x, y in common_lines(a[i:ni], b[j:nj])]
        out.append((ni, nj))
        i, j = ni + 1, nj + 1
    return out[:-1]


_PAIRS = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))


def _kept(a: Column, b: Column, anchor_i: Column, anchor_j: Column) -> Column:
    def run(left: pa.Array, right: pa.Array, at_i: pa.Array, at_j: pa.Array) -> pa.Array:
        texts = ((x.as_py(), y.as_py(), list(zip(i.as_py(), j.as_py(), strict=True))) for x, y, i, j in zip(left, right, at_i, at_j, strict=True))
        return pa.array([[{"i": i, "j": j} for i, j in kept_places(*t)] for t in texts], _PAIRS)

    return F.arrow_udf(run, "array<struct<i:int,j:int>>")(a, b, anchor_i, anchor_j)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row: within a lambda it would be made for every element."""
    return F.transform(F.array(value), use)[0]


def _span(first: Column, behind: Column, tell: Callable[[Column], Column]) -> Column:
    """``tell`` of the places from ``first`` up to the one before ``behind``; none if there are none."""
    return F.transform(F.filter(F.sequence(first, F.greatest(first, behind - 1)), lambda x: x < behind), tell)


def _at(i: Column, j: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))


def _anchors(a: Column, b: Column) -> Column:
    """array<struct<i, j>>: the lines that stand once in either text, by their places in the first one."""
    side = lambda text, n: F.transform(text, lambda line, place: F.struct(line.alias("line"), F.lit(n).alias("side"), place.alias("place")))

    def pairs(s: Column) -> Column:
        # Equal lines stand together: an anchor is a run of two, one of either side.
        line = lambda k: F.get(s, k)["line"]
        alone = lambda k: F.coalesce(line(k) != line(k - 1), F.lit(True)) & F.coalesce(line(k + 1) != line(k + 2), F.lit(True))
        is_anchor = lambda k: (line(k) == line(k + 1)) & (F.get(s, k)["side"] == 0) & (F.get(s, k + 1)["side"] == 1) & alone(k)
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s)), is_anchor), lambda k: _at(F.get(s, k)["place"], F.get(s, k + 1)["place"])))

    return _once(F.sort_array(F.concat(side(a, 0), side(b, 1))), pairs)


def _ends(kept: Column, n: Column, m: Column) -> Column:
    """array<struct<i, j, ni, nj>>: the spans between kept lines: each from behind one (i, j) to the next one (ni, nj)."""
    before, behind = F.concat(F.array(_at(F.lit(-1), F.lit(-1))), kept), F.concat(kept, F.array(_at(n, m)))
    return F.zip_with(before, behind, lambda x, y: F.struct((x["i"] + 1).alias("i"), (x["j"] + 1).alias("j"), y["i"].alias("ni"), y["j"].alias("nj")))


def line_diff(df: DataFrame, key: str, base: str, later: str) -> DataFrame:
    """(key, place, op, line, i, j): the script from each base text to the later one: ' ' kept, '-' deleted, '+' inserted.

    ``i`` and ``j`` count the lines of either text before this one. A row holds both texts, so that its script is made where the row is:
    nothing is shuffled or joined.
    """
    told = df.select(key, cut_lines(F.col(base)).alias("_a"), cut_lines(F.col(later)).alias("_b"))
    told = told.select(key, "_a", "_b", _anchors(F.col("_a"), F.col("_b")).alias("_at"))
    told = told.select(key, "_a", "_b", _kept(F.col("_a"), F.col("_b"), F.col("_at.i"), F.col("_at.j")).alias("_kept"))

    def script(t: Column) -> Column:
        a, b = t["_a"], t["_b"]
        row = lambda op, line, i, j: F.struct(F.lit(op).alias("op"), line.alias("line"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        # Between two kept lines deletions come first.
        gone = lambda g: _span(g["i"], g["ni"], lambda x: row("-", F.get(a, x), x, g["j"]))
        come = lambda g: _span(g["j"], g["nj"], lambda y: row("+", F.get(b, y), g["ni"], y))
        kept = lambda g: F.filter(F.array(row(" ", F.get(a, g["ni"]), g["ni"], g["nj"])), lambda x: x["i"] < F.size(a))
        return F.flatten(F.transform(_ends(t["_kept"], F.size(a), F.size(b)), lambda g: F.concat(gone(g), come(g), kept(g))))

    all_ = _once(F.struct("_a", "_b", "_kept"), script)
    # An inner explode would have the script made once more, to filter by its size.
    return told.select(key, F.posexplode_outer(all_).alias("place", "_s")).filter("place IS NOT NULL").select(key, "place", "_s.*")


def hunks(script: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, hunk, header, lines): runs of changes with ``context`` kept lines around them, as a unified diff writes them."""
    along = Window.partitionBy(key).orderBy("place")
    changed = F.max((F.col("op") != " ").cast("int")).over(along.rowsBetween(-context, context))
    held = script.withColumn("_in", changed == 1)
    begins = F.col("_in") & ~F.coalesce(F.lag("_in").over(along), F.lit(False))
    held = held.withColumn("_hunk", F.sum(begins.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))).filter("_in")
    size = lambda other: F.sum((F.col("op") != other).cast("int"))
    g = held.groupBy(key, F.col("_hunk").cast("int").alias("hunk")).agg(
        F.min("i").alias("_i"), size("+").alias("_n"), F.min("j").alias("_j"), size("-").alias("_m"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("op", "line").alias("text")))), lambda x: x["text"]).alias("lines"),
    )

    def span(begin: str, n: str) -> Column:
        first = F.when(F.col(n) == 0, F.col(begin)).otherwise(F.col(begin) + 1)
        return F.when(F.col(n) == 1, first.cast("string")).otherwise(F.concat_ws(",", first, F.col(n)))

    return g.select(key, "hunk", F.concat(F.lit("@@ -"), span("_i", "_n"), F.lit(" +"), span("_j", "_m"), F.lit(" @@")).alias("header"), "lines")


def unified(found: DataFrame, key: str, most: int | None = None, names: tuple[str, str] = ("base", "effective")) -> DataFrame:
    """(key, excerpt): the first ``most`` lines of each unified diff."""
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("hunk", F.concat(F.array("header"), "lines").alias("text")))), lambda x: x["text"])
    text = F.concat(F.array(F.lit(f"--- {names[0]}"), F.lit(f"+++ {names[1]}")), F.flatten(all_))
    return found.groupBy(key).agg((F.slice(text, 1, most) if most else text).alias("_text")).select(key, F.array_join("_text", "\n").alias("excerpt"))
