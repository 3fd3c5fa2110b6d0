import random

import numpy as np

from brindle.llm import jaccard

SCHEMA = "doc_id bigint, text string, extra int"


def sets(text):
    low = (text or "").encode().lower().split()
    return {tuple(low)} if 0 < len(low) < 4 else {tuple(low[i : i + 4]) for i in range(len(low) - 3)}


def brute(rows):
    all_sets = [(i, sets(t)) for i, t in rows]
    lead = {i: i for i, _ in rows}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for k, (i, a) in enumerate(all_sets):
        for j, b in all_sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                lead[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in all_sets}


def found(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_texts(df).collect()}


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("aé") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words = words[: rng.randint(1, len(words))]
        else:
            words = [word() for _ in range(rng.choice([1, 3, 5, 9, 20, 60, 150, 400]))] + (passage if rng.random() < 0.4 else [])
        text = " ".join(words)
        rows.append((2 * i, text.upper() if rng.random() < 0.1 else text))
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spark, rows) == brute(rows)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rows = corpus(3, 200)
    assert found(spark, rows) == brute(rows)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(4)
    edges = jaccard.bounds(1 << 40)
    for _ in range(1500):
        n = int(rng.integers(7, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a
        while True:
            c = np.unique(rng.choice(b, len(b) - 1, replace=False) if rng.random() < 0.5 else np.append(b, rng.integers(0, 1 << 63, 1).astype(np.uint64)))
            if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                break
            b = c
        if len(np.setxor1d(a, b)):
            assert len(np.intersect1d(jaccard.signatures(a, edges), jaccard.signatures(b, edges)))


def test_signature_tree_finds_all_pairs():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64)) for _ in range(40)]
    sets_ = [np.unique(np.append(rng.choice(s, len(s) - int(rng.integers(0, 12)), replace=False), rng.integers(0, 1 << 63, int(rng.integers(0, 6))).astype(np.uint64))) for s in base for _ in range(5)]
    by_size = np.array(sorted(range(len(sets_)), key=lambda i: len(sets_[i])))
    got, want = jaccard.Unions(len(sets_)), jaccard.Unions(len(sets_))
    maps, n = np.stack([jaccard.bitmap(s, 256) for s in sets_]), np.array([len(s) for s in sets_])
    assert (np.stack([jaccard.folded(jaccard.bitmap(s, 1024), 4) for s in sets_]) == maps).all()
    jaccard.link(maps, n, by_size, by_size, 85, got, sets_)
    for i in range(len(sets_)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets_[i], sets_[j])) >= 85 * len(np.union1d(sets_[i], sets_[j])):
                want.join(i, j)
    assert [got.find(i) for i in range(len(sets_))] == [want.find(i) for i in range(len(sets_))]


def test_nulls_and_empty(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(1, None, 1), (2, "  ", 1), (3, "a b", 1), (3, "a b", 1), (None, "a b", 1), (9, "A  b", 1)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_texts(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (9, 1, 3)], key=str)
