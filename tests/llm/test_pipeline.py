import random
import re

import numpy as np

import corpus_pipeline as p
from brindle.llm import classifier, packing, secrets
from brindle.llm.common import Scratch, released

from .test_defined_cases import check_packing
from .test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.001"


def planted(spark, path):
    """The smallest documents, and copies, near copies, shared passages and secrets among them; odd rows and columns."""
    rng = random.Random(4)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = [t for _, t, _ in rows if t and len(t.split()) > 80]
    passage = long[0][:400]
    for i in range(40):
        words = rng.choice(long).split(" ")
        if i % 4 == 1:
            words[rng.randrange(len(words))] = "changed"
        if i % 4 == 2:
            words.insert(len(words) // 2, passage)
        if i % 4 == 3:
            rng.shuffle(words)
            words.insert(len(words) // 2, "password = hunter2hunter2")
        rows.append((10_000 + i, " ".join(words), "planted"))
    rows += [(None, long[1], "s"), (None, None, "s"), (20_000, None, None), (20_001, "", None), (rows[0][0], long[2], "s"), (rows[0][0], rows[0][1], "s")]
    given = [(*r, None if r[1] is None else len(r[1]), 1, 2, 3, 4, 5) for r in rows]
    df = spark.createDataFrame(given, "doc_id bigint, text string, source string, n_chars bigint, _spans int, _had int, _score int, _gone int, _key int")
    df.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)


def shingles(text):
    low = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(low[i : i + 5]) for i in range(len(low) - 4)} or ({tuple(low)} if low else set())


def brute_near(rows):
    lead = {}

    def find(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                lead[max(x, y)] = min(x, y)
    return [r for r in rows if r.doc_id is None or find(r.doc_id) == r.doc_id]


def brute_repeats(rows, length=100):
    """Texts without the bytes of strings that start earlier; rows that repeat an id and a text are one document."""
    seen, out = {}, []
    for r in sorted(rows, key=key):
        data = (r.text or "").encode()
        for s in range(len(data) - length + 1 if r.doc_id is not None else 0):
            seen.setdefault(data[s : s + length], (r.doc_id, s))
    for r in rows:
        data = (r.text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1 if r.doc_id is not None else 0):
            if seen[data[s : s + length]] != (r.doc_id, s):
                gone[s : s + length] = True
        text, at = [], 0
        edges = np.flatnonzero(np.diff(np.append(False, gone).astype(np.int8))).tolist() + [len(data)]
        for b, e in zip(edges[::2], edges[1::2] + [len(data)]):
            text.append(data[at:b].decode("utf-8", "ignore"))
            at = e
        text = "".join(text) + data[at:].decode("utf-8", "ignore")
        if not (r.text or "").strip(" ") or text.strip(" "):
            out.append((r.doc_id, None if r.text is None else text))
    return out


def redacted(text):
    out, used = [], 0
    for _, a, b in brute_spans(text):
        if a >= used:
            out.append(text[used:a] + "[SECRET]")
        used = max(used, b)
    return "".join(out) + text[used:]


def test_run_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    planted(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    scratch, after = Scratch(spark), [docs]
    for name, stage in p.STAGES:
        after.append(scratch.table(stage(spark, after[-1], path), name))
    rows = [t.collect() for t in after]
    assert all(t.columns == docs.columns for t in after[:-1])
    pairs = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)

    weights = classifier.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = lambda t: (lambda s, v: float(weights[-1]) + float(weights[s].astype(float) @ v.astype(float)))(*classifier.features(t)) >= np.log(0.3 / 0.7)
    assert pairs(rows[1]) == pairs(r for r in rows[0] if good(r.text)), names[0]
    assert pairs(rows[2]) == pairs(brute_near(rows[1])), names[1]
    assert sorted(((r.doc_id, r.text) for r in rows[3]), key=str) == sorted(brute_repeats(rows[2]), key=str), names[2]
    assert sorted(((r.doc_id, r.text) for r in rows[4]), key=str) == sorted(((r.doc_id, r.text and redacted(r.text)) for r in rows[3]), key=str), names[3]
    assert all(len(a) > len(b) for a, b in zip(rows[:3], rows[1:3])) and any("[SECRET]" in (r.text or "") for r in rows[4])
    assert all((r._spans, r._had, r._score, r._gone, r._key) == (1, 2, 3, 4, 5) and r.n_chars == (None if r.text is None else len(r.text)) for r in rows[4])
    words = {}
    for r in rows[4]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    for r in rows[5]:
        words[r.doc_id] -= r.n_words
    assert not any(words.values())
    source = {r.doc_id: r.source for r in rows[4]}
    check_packing(rows[5], packing.CAPACITY, packing.PER_SOURCE, lambda r: source[r.doc_id] if r.doc_id is not None else None, lambda r: None)
    # run() does the same, stage after stage, and leaves its last table only.
    assert sorted(map(str, p.run(spark, path).drop("bin_id", "bin_words").collect())) == sorted(map(str, after[-1].drop("bin_id", "bin_words").collect()))


def test_released_folders_are_gone(spark):
    from pathlib import Path

    with released():
        inner = Scratch(spark)
        inner.table(spark.range(3), "t")
        assert Path(inner.path).exists()
    assert not Path(inner.path).exists()


def test_no_spans_are_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scanner = secrets.scanner(secrets.RULES)
    assert not any(scanner.spans(r.text or "") for r in p.secret_scans(spark, docs, SF).select("text").collect())


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classifier.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
