import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from brindle.operators import sequences


def test_equal_and_contained_names_come_first(spark):
    names = ["antique steel", "antique stee", "antique steels", "antique", "an antique steel thing", "", None]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, s string").select("i", sequences.similarity(F.col("s"), F.lit("antique steel")).alias("x")).collect()
    got = {r.i: r.x for r in rows}
    assert got[0] == 1.0
    assert got[1] == pytest.approx(0.95 * 12 / 13) and got[2] == pytest.approx(0.95 * 13 / 14)
    assert got[3] == pytest.approx(14 / 20) and got[4] == pytest.approx(26 / 35)
    assert got[5] == got[6] == 0.0


def words(seed, n, letters="abcde", most=14):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n // 4 + 1)]

    def odd(w):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[i:] + w[:i]])
        return w

    return [odd(rng.choice(base)) for _ in range(n)]


def test_ratio_of_random_pairs():
    rng = random.Random(1)
    pool = words(2, 3000, "ab") + words(3, 3000) + words(4, 2000, "abcdefghijklmnopqrstuvwxyzé", 30) + ["", "a"]
    for _ in range(10_000):
        a, b = rng.choice(pool), rng.choice(pool)
        assert sequences.matching_ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


def slow_similarity(a, b):
    if a == b:
        return 1.0
    share = min(len(a), len(b)) / max(len(a), len(b))
    if (a in b or b in a) and share >= 0.7:
        return 0.95 * share
    grams = lambda w: {f"  {w}  "[i : i + 3] for i in range(len(w) + 2)}
    return max(SequenceMatcher(None, a, b, autojunk=False).ratio(), len(grams(a) & grams(b)) / len(grams(a) | grams(b)))


@pytest.mark.parametrize(("least", "letters"), [(0.84, "abcde"), (0.84, "ab"), (0.8, "abc"), (0.95, "ab"), (0.7, "abc"), (0.5, "abcd")])
def test_pairs_against_all_pairs(spark, least, letters):
    """Also words of two letters, whose grams repeat, and thresholds that need shorter grams."""
    terms, held = sorted(set(words(5, 80, letters))), sorted(set(words(5, 400, letters)))
    t = spark.createDataFrame([(x,) for x in [*terms, None, "", " ABC "]], "term string")
    w = spark.createDataFrame([(x,) for x in [*held, *held[:9], None, "", "abc"]], "word string")
    got = {(r.term, r.word): r.score for r in sequences.similar_pairs(t, w, least).collect()}
    terms, held = {*terms, "abc"} - {""}, {*held, "abc"} - {""}
    want = {(a, b): x for a in terms for b in held if (x := slow_similarity(a, b)) >= least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > len(terms)


def test_common_characters_bound_the_matches(spark):
    rows = [("aabb", "abab"), ("abc", "xyz"), ("aab", "ab"), ("", "a")]
    got = [r.n for r in spark.createDataFrame(rows, "a string, b string").select(sequences.common_characters(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [4, 0, 2, 0]
    assert [sequences.gram_size(x) for x in (0.9, 0.8, 0.7, 0.6)] == [3, 3, 2, 1]
