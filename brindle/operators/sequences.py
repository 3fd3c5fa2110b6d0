"""Similarity of words by their longest matching blocks; many terms are matched against many words in one join.

The longest block that two words share is taken (the first one in either word on ties), then the longest ones on its left
and on its right, and so on; the ratio is twice the matched length over both lengths. Pairs whose ratio or trigram
similarity can reach a threshold are found through an inverted index of grams: with u of T characters unmatched there are
u + 1 blocks at most, blank padding lengthens the outer ones, and so a pair at the threshold shares a least number of grams.
Terms leave out their most frequent grams up to that number. Exact bounds on the lengths and on the counts of characters
thin the pairs before any block is sought.

Null and empty words are like nothing; words are compared in lower case and trimmed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_sets_jaccard

#: A contained word counts from this share of the length on, with this weight.
CONTAINED, CONTAINED_WEIGHT = 0.7, 0.95


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common run; of equal ones the first in a, then in b.

    A common run of some length holds common runs of all smaller ones, so that the length is found by halving.
    """
    low, high = 0, min(len(a), len(b))
    while low < high:
        size = (low + high + 1) // 2
        there = {b[j : j + size] for j in range(len(b) - size + 1)}
        if any(a[i : i + size] in there for i in range(len(a) - size + 1)):
            low = size
        else:
            high = size - 1
    if not low:
        return 0, 0, 0
    i = next(i for i in range(len(a) - low + 1) if a[i : i + low] in b)
    return i, b.index(a[i : i + low]), low


def matching_ratio(a: str, b: str) -> float:
    """Twice the length of all matching blocks over the length of both words; 1 for two empty ones."""
    if not a and not b:
        return 1.0
    todo, matched = [(a, b)], 0
    while todo:
        x, y = todo.pop()
        i, j, size = longest_block(x, y)
        if size:
            matched += size
            todo += [(x[:i], y[:j]), (x[i + size :], y[j + size :])]
    return 2 * matched / (len(a) + len(b))


def ratio(a: Column, b: Column) -> Column:
    """double: the matching ratio of two words; null where one is null."""

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else matching_ratio(x, y) for x, y in pairs], pa.float64())

    return F.arrow_udf(run, "double")(a, b)


def grams(word: Column, size: int = 3) -> Column:
    """All runs of ``size`` characters of a word between size - 1 blanks on either side, repeated ones too."""
    pad = F.lit(" " * (size - 1))
    padded = F.concat(pad, word, pad)
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (size - 1)), lambda i: F.substring(padded, i, F.lit(size)))


def similarity(a: Column, b: Column, block_ratio: Column | None = None) -> Column:
    """1 for equal words; a contained word counts by its share, from CONTAINED on; else the larger of matching ratio and trigram similarity."""
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    within = (F.contains(a, b) | F.contains(b, a)) & (share >= CONTAINED)
    sets = token_sets_jaccard(F.array_distinct(grams(a)), F.array_distinct(grams(b)))
    blank = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    like = F.greatest(ratio(a, b) if block_ratio is None else block_ratio, sets)
    return F.when(blank, 0.0).when(a == b, 1.0).when(within, CONTAINED_WEIGHT * share).otherwise(like)


def gram_size(least: float) -> int:
    """The longest grams of which a pair at the threshold must share one, whatever its lengths."""
    if not 0 < least <= 1:
        raise ValueError("the threshold must lie above 0 and be 1 at most")
    return 3 if least >= 0.8 else 2 if least > 2 / 3 else 1


def least_shared(least: float, total: Column) -> Column:
    """How many grams two words of ``total`` characters share, at the threshold or above, counting repeated ones.

    Of T characters u <= (1 - least) * T are unmatched, the rest and the padding stand in u + 1 blocks at most, and a block of
    n characters has n - size + 1 grams. The trigram similarity needs one shared gram only, and is bounded by sets.
    """
    size = gram_size(least)
    unmatched = (1 - least) * total + F.lit(1e-9)
    return F.greatest(F.lit(1), F.ceil((total - unmatched) / 2 + 2 * (size - 1) - (size - 1) * (unmatched + 1) - 1e-6).cast("int"))


def _surplus(word: Column, least: float) -> Column:
    """How many grams (with repetition) a term may leave out: one less than the least number shared, at the shortest partner."""
    n = F.length(word)
    shortest = F.ceil(n * least / (2 - least) - 1e-9)
    by_ratio = least_shared(least, n + shortest) - 1
    # Sets at the threshold share that part of the term's distinct trigrams.
    by_sets = F.ceil(least * F.size(F.array_distinct(grams(word))) - 1e-9).cast("int") - 1 if gram_size(least) == 3 else F.lit(0)
    return F.greatest(F.lit(0), F.least(by_ratio, by_sets))


def characters(word: Column) -> Column:
    return F.split(word, "")


def letters(word: Column) -> Column:
    """The set of a word's characters as 64 bits; characters that share a bit only make sets look closer."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.filter(characters(word), lambda c: c != ""), F.lit(0).cast("bigint"), lambda x, c: x.bitwiseOR(bit(c)))


def common_characters(a: Column, b: Column) -> Column:
    """The size of both words' common multiset of characters, which no matching exceeds."""
    each = F.array_distinct(F.filter(characters(a), lambda c: c != ""))
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    return F.aggregate(F.transform(each, lambda c: F.least(count(a, c), count(b, c))), F.lit(0), lambda x, y: x + y)


def similar_pairs(terms: DataFrame, words: DataFrame, least: float = 0.84, term: str = "term", word: str = "word") -> DataFrame:
    """(term, word, score) of all pairs of distinct terms and words with a similarity of ``least`` or more."""
    size = gram_size(least)
    clean = lambda df, c, name: df.select(F.lower(F.trim(c)).alias(name)).filter(f"{name} != ''").distinct()
    asked, held = clean(terms, term, "term"), clean(words, word, "word")
    # Distinct words are few bytes, which Spark would put into one task, whatever is made of them: a set number keeps them apart. By the
    # word itself they lie apart already, and the step would be left out.
    held = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("word"))
    sets = F.size(F.array_distinct(grams(F.col("word"))))
    index = held.select("word", F.length("word").alias("n"), sets.alias("n_set"), letters(F.col("word")).alias("n_letters"), F.explode(F.array_distinct(grams(F.col("word"), size))).alias("gram"))
    common = index.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    # The term's grams, the rarest first; what the most frequent ones would add is reached through the others.
    own = asked.select("term", _surplus(F.col("term"), least).alias("_spare"), F.explode(grams(F.col("term"), size)).alias("gram"))
    own = own.groupBy("term", "gram").agg(F.count(F.lit(1)).alias("times"), F.first("_spare").alias("_spare")).join(common, "gram")
    behind = Window.partitionBy("term").orderBy(F.desc("held"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_left_out", F.sum("times").over(behind)).filter("_left_out > _spare")
    own = own.select("term", "gram", "times", "_spare", F.length("term").alias("m"), F.size(F.array_distinct(grams(F.col("term")))).alias("m_set"), letters(F.col("term")).alias("m_letters"))
    # A letter that one word has alone stays unmatched; of those that the sets' difference holds, a trigram has three at most.
    alone = F.bit_count(F.col("m_letters").bitwiseXOR(F.col("n_letters")))
    by_length = 2 * F.least("m", "n") >= least * (F.col("m") + F.col("n")) - 1e-9
    by_set = F.least("m_set", "n_set") >= least * F.greatest("m_set", "n_set") - 1e-9
    near = by_length & (alone <= (1 - least) * (F.col("m") + F.col("n")) + 1e-9) | by_set & (alone <= 3 * (1 - least) / (1 + least) * (F.col("m_set") + F.col("n_set")) + 1e-9)
    told = [F.first(c).alias(c) for c in ("m", "n", "m_set", "n_set", "_spare")]
    # Only numbers are gathered: with texts among them Spark sorts all that is joined instead of hashing it.
    pairs = own.join(index, "gram").filter(near).groupBy("term", "word").agg(F.sum("times").alias("_shared"), *told)
    # What a pair shares at most, with the grams that were left out.
    a, b, shared = F.col("term"), F.col("word"), F.col("_shared") + F.col("_spare")
    enough = (shared >= least_shared(least, F.col("m") + F.col("n"))) & (2 * common_characters(a, b) >= least * (F.col("m") + F.col("n")) - 1e-9)
    sets = shared >= least / (1 + least) * (F.col("m_set") + F.col("n_set")) - 1e-9 if size == 3 else by_set
    # The score hangs on what was gathered, so that no filter on it, which costs, moves below the grouping.
    scored = pairs.filter(by_length & enough | sets).select("term", "word", F.when(F.col("_shared") > 0, similarity(a, b)).alias("score"))
    return scored.filter(F.col("score") >= least)
