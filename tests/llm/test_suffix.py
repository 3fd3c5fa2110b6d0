import hashlib
import random

import numpy as np

from brindle.llm import suffix

SCHEMA = "doc_id bigint, text string, extra int"


def brute(rows, length=100):
    """(n_bytes, n_removed, n_spans, sha256) by id, from a dictionary of all strings."""
    out, seen = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if seen.setdefault(data[s : s + length], (doc_id, s)) != (doc_id, s):
                gone[s : s + length] = b"\1" * length
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix.find_repeats(df, **kw).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéñ") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 50))))
        text = " ".join(parts)
        if rows and rng.random() < 0.3:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        rows.append((i * 3, text))
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(spark, rows) == brute(rows)


def test_hot_anchors_and_periodic_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    rows = corpus(3) + [(1000, "ab" * 300), (1001, "x" * 500), (1002, "x" * 99), (1003, "x" * 101), (1004, ""), (1005, None), (1006, "ab" * 300)]
    assert found(spark, rows) == brute(rows)


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 512)
    rows = corpus(4, 20)
    rows.append((999, " ".join(t for _, t in rows)))
    texts = [t.encode() for _, t in rows]
    covered = [0] * len(texts)
    for number, _, size, _ in suffix.segments(texts):
        for i, n in zip(number.tolist(), size.tolist()):
            covered[i] += n
    assert covered == [max(0, len(t) - 99) for t in texts]


def test_sort_is_lexicographic_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(5)
    data = bytes(rng.choice(list(b"ab"), 3000).astype(np.uint8))
    at = rng.permutation(2800)[:900]
    group = np.sort(rng.integers(0, 7, 900))
    want = sorted(range(900), key=lambda i: (group[i], data[at[i] : at[i] + 100]))
    order, new = suffix.equal_strings(data, at, group, 100)
    strings = lambda o: [(group[i], data[at[i] : at[i] + 100]) for i in o]
    assert strings(order) == strings(want)
    assert int(new.sum()) == len(set(strings(want)))
    monkeypatch.setattr(suffix.Suffixes, "same", lambda self, a, b, n: np.ones(len(a), bool))
    order, new = suffix.equal_strings(data, at, group, 100)
    assert int(new.sum()) == len(set(strings(want)))


def test_nulls_repeats_and_empty(spark):
    long = "the quick brown fox " * 10
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, long, 1), (5, long, 1), (5, long, 2), (6, long, 1)], SCHEMA)
    got = sorted(((r.doc_id, r.n_removed) for r in suffix.find_repeats(df).collect()), key=str)
    inside = brute([(5, long)])[5][1]
    assert got == [(5, inside), (5, inside), (6, 200), (None, 0)]


def test_strip(spark):
    long = "é " + "lorem ipsum dolor sit amet " * 6 + "unique tail of the first"
    df = spark.createDataFrame([(1, long, 1), (2, "other start " + long[:140], 2), (3, None, 3)], SCHEMA)
    got = {r.doc_id: r for r in suffix.strip(df, suffix.find_repeats(df)).collect()}
    assert got[2].text.startswith("other start") and len(got[2].text) < 60 and got[3].text is None and got[1].extra == 1
