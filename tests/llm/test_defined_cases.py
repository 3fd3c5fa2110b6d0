"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for the operators on documents."""

import itertools
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, classifier, jaccard, packing, quality_rules, queries, secrets, sharding, suffix
from brindle.llm.common import Scratch, components, fresh

LONG = "word " * 60_000
PLAIN = " ".join(f"plain{i} text" for i in range(80))
CLASHING = "words string, _words string, _lines int, n_words int, kept string, shard int, slot int, _slot int, _key int, _id int, _spans int, _repeat int, score int, held_out int"


def odd_rows(spark, empty=False):
    """Every odd case, with columns that clash with the operators' own."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, PLAIN), (5, PLAIN), (5, PLAIN), (5, "other"), (None, PLAIN), (None, None), (6, LONG), (7, "é"), (8, "one two")]
    rest = ("w", "w", 1, 2, "k", 3, 4, 5, 6, 7, 8, 9, 10, 11)
    return spark.createDataFrame([] if empty else [(*t, "s", *rest) for t in texts], f"doc_id bigint, text string, source string, {CLASHING}")


def test_fresh_names():
    assert fresh(["a", "A_", "b"], "a", "b", "c", "c") == ["a__", "b_", "c", "c_"]


@pytest.mark.parametrize("empty", [False, True])
def test_quality_rules(spark, empty):
    df = odd_rows(spark, empty)
    out = quality_rules.quality_rules(df)
    assert len(set(out.columns)) == len(out.columns) and {"words", "_words", "_lines"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == df.count() and all(r.words == "w" and r._words == "w" and r._lines == 1 for r in rows)
    kept = Counter((r.doc_id, r.kept) for r in rows)
    if not empty:
        assert kept[4, True] == 1 and kept[5, True] == 2 and kept[5, False] == 1 and kept[1, False] == kept[6, False] == 1
        assert {r.doc_id: r.n_words for r in rows if r.doc_id in (1, 2, 3, 6, 7)} == {1: 0, 2: 0, 3: 0, 6: 60_000, 7: 1}


def test_cascade_orders_by_rejection_per_cost(spark):
    df = spark.range(2000).select((F.col("id") % 10).alias("x"), F.repeat(F.lit("ab"), 5000).alias("t")).limit(1000)
    dear = lambda most: (F.length(F.regexp_replace("t", "a.*?b", "x")) > 0) & (F.col("x") < most)
    rules = [quality_rules.Rule("never", F.col("x") >= 0), quality_rules.Rule("dear", dear(5)), quality_rules.Rule("cheap", F.col("x") < 5), quality_rules.Rule("seldom", F.col("x") != 3)]
    names = [r.name for r in quality_rules.plan_cascade(df, rules)]
    assert names[-1] == "never" and names.index("cheap") < names.index("dear")


@pytest.mark.parametrize("empty", [False, True])
def test_sharding(spark, empty):
    df = odd_rows(spark, empty)
    out = sharding.shard(df, "doc_id", queries.SHARD_NAMES)
    assert len({c.lower() for c in out.columns}) == len(out.columns) == len(df.columns)
    rows = out.collect()
    assert len(rows) == df.count() and all(r._slot == 5 for r in rows)
    by_key = defaultdict(set)
    for r in rows:
        by_key[r.doc_id].add((r.slot, r.shard))
    assert all(len(v) == 1 for v in by_key.values())
    # The key may itself have the name of an added column.
    assert sharding.shard(df, "shard", queries.SHARD_NAMES).count() == df.count()


def test_sharding_table_against_the_definition():
    owner = sharding.fill_table(queries.SHARD_NAMES, 101)
    shares = Counter(owner)
    assert len(owner) == 101 and set(shares) == set(range(40)) and max(shares.values()) - min(shares.values()) <= 1


@pytest.mark.parametrize("empty", [False, True])
def test_suffix_strip(spark, empty):
    df = odd_rows(spark, empty)
    out = suffix.strip(df, suffix.find_repeats(df))
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == df.count() and all((r._key, r._id, r._spans) == (6, 7, 8) for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_jaccard(spark, empty):
    rows = jaccard.similar_texts(odd_rows(spark, empty)).collect()
    if empty:
        assert rows == []
        return
    got = Counter((r.doc_id, r.component_id) for r in rows)
    assert got == {(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 4): 2, (5, 5): 1, (None, None): 2, (6, 6): 1, (7, 7): 1, (8, 8): 1}


def test_bpe(spark):
    import tokenizers

    path = queries.tokenizer_path()
    whole = tokenizers.Tokenizer.from_file(path)
    df = odd_rows(spark).withColumn("ids", bpe.encode(F.col("text"), path)).withColumn("back", bpe.decode(F.col("ids"), path))
    for r in df.collect():
        want = whole.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.back == whole.decode(want, skip_special_tokens=False) and r._id == 7
    assert odd_rows(spark, True).select(bpe.encode(F.col("text"), path)).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_classifier(spark, empty):
    df = odd_rows(spark, empty)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 1), (None, 1), (9, None)], "doc_id bigint, quality int")
    for given in (labels, labels.filter("false")):
        out = classifier.classify(df, given)
        assert len(set(out.columns)) == len(out.columns)
        rows = out.collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r._id == 7 for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) <= 1


def check_packing(rows, capacity, per_source, source_of, cluster_of):
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.n_words for r in held) <= capacity and {sum(r.n_words for r in held)} == {r.bin_words for r in held}
        for of, most in ((source_of, per_source), (cluster_of, 1)):
            keys = Counter(k for r in held if (k := of(r)) is not None)
            assert not keys or max(keys.values()) <= most
    return bins


def test_packing(spark):
    df = odd_rows(spark)
    rows = packing.pack(df, capacity=100).collect()
    assert {r.bin_id for r in rows if not r.n_words} == {None} and sum(r.n_words == 0 for r in rows) == 4
    assert sorted(r.n_words for r in rows if r.doc_id == 6) == [100] * 600
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    assert words == Counter({1: 0, 2: 0, 3: 0, 4: 160, 5: 321, 6: 60_000, 7: 1, 8: 2, None: 160})
    assert packing.pack(odd_rows(spark, True)).collect() == []


def brute_places(lengths, clusters, sources, capacity, per_source):
    """Best fit by looking at every bin: the tightest one that admits the row, the oldest on ties."""
    bins, places = [], []
    for n, c, s in zip(lengths, clusters, sources, strict=True):
        fits = [
            (capacity - sum(x for x, *_ in held), b) for b, held in enumerate(bins)
            if sum(x for x, *_ in held) + n <= capacity and (c is None or all(c != y for _, y, _ in held)) and (s is None or sum(s == z for *_, z in held) < per_source)
        ]
        b = min(fits)[1] if fits else len(bins)
        if b == len(bins):
            bins.append([])
        bins[b].append((n, c, s))
        places.append(b)
    return places


def test_best_fit_against_all_bins():
    import random

    for seed in range(40):
        rng = random.Random(seed)
        n = rng.randint(0, 80)
        lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        sources = [rng.choice([None, "a", "a", "a", "b", "c"]) for _ in range(n)]
        assert packing.pack_rows(lengths, clusters, sources, 100, 3) == brute_places(lengths, clusters, sources, 100, 3)


def test_packing_holds_conflicts_over_a_corpus(spark, tmp_path):
    texts = [(i, f"t{i % 50} " + "w " * (i * 37 % 900), f"s{min(i % 7, 2)}") for i in range(3000)] + [(5000, PLAIN, "s0")] * 40
    spark.createDataFrame(texts, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    source, text = {i: s for i, _, s in texts}, {i: " ".join(t.split()) for i, t, _ in texts}
    bins = check_packing(rows, packing.CAPACITY, packing.PER_SOURCE, lambda r: source[r.doc_id], lambda r: text[r.doc_id])
    assert len(rows) == len(texts) and len(list(itertools.chain(*bins.values()))) == len(rows)


def test_components_of_chains_and_stars(spark):
    scratch = Scratch(spark)
    for edges in ([(i, i + 1) for i in range(600)], [(7, i) for i in range(8, 3000)], [(5000, i) for i in range(1000)], [(i, i) for i in range(5)], [], [(1, 2), (4, 3), (3, 2), (9, 8)]):
        lead = {}

        def find(x, lead=lead):
            while lead.setdefault(x, x) != x:
                x = lead[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            lead[max(x, y)] = min(x, y)
        want = {x: find(x) for x in lead if find(x) != x}
        got = components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()
        assert {r.id: r.component_id for r in got} == want and len(got) == len(want)
    scratch.close()


def test_one_step_of_the_classifier():
    """A first step of follow-the-regularised-leader from nothing, against its formulas."""
    import numpy as np

    slots, shares = np.array([3, 9]), np.array([0.5, 2.0])
    old, classifier.EPOCHS = classifier.EPOCHS, 1
    try:
        w = classifier.learn([(slots, shares, 1)])
    finally:
        classifier.EPOCHS = old
    for at, x in ((3, 0.5), (9, 2.0), (1 << classifier.BITS, 1.0)):
        g = -0.5 * x
        want = -(g - np.sign(g) * classifier.L1) / ((classifier.BETA + abs(g)) / classifier.ALPHA + classifier.L2)
        assert w[at] == pytest.approx(want, rel=1e-5)
    assert np.count_nonzero(w) == 3


def test_scores_against_all_features(spark):
    """Scores are dot products of the weights with all features of the whole text."""
    import numpy as np

    weights = np.random.default_rng(1).normal(size=(1 << classifier.BITS) + 1).astype(np.float32)
    rows = classifier.score(odd_rows(spark), weights).collect()
    for r in rows:
        slots, shares = classifier.features(r.text)
        logit = float(weights[-1]) + float(weights[slots].astype(float) @ shares.astype(float))
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_redaction_leaves_clashing_columns_alone(spark):
    df = odd_rows(spark)
    out = df.withColumn("found", secrets.scan(F.col("text"))).withColumn("text", secrets.redact("text", "found"))
    assert out.select("_spans").distinct().collect()[0][0] == 8 and out.count() == df.count()
