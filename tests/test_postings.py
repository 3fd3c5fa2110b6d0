import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import search
from brindle.sources import postings


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 200])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "rareword w0"), (n + 3, "rareword rareword rareword w1")]


def brute(rows, terms, k, mode):
    docs = {i: re.findall(r"\b[a-z0-9]{2,}\b", (t or "").lower()) for i, t in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    tfs = {i: Counter(w) for i, w in docs.items()}
    df = {t: sum(t in tf for tf in tfs.values()) for t in terms}
    out = []
    for i, tf in tfs.items():
        score = 0.0
        for t in terms:
            if tf[t]:
                f = 1 if mode == "binary" else tf[t]
                score += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * 2.8 / (f + 1.8 * (0.25 + 0.75 * len(docs[i]) / mean))
        if score > 0:
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = corpus(1, 3000)
    path = str(tmp_path_factory.mktemp("index") / "it")
    postings.build(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), path, block_docs=32)
    return rows, postings.PostingIndex(spark, path)


@pytest.mark.parametrize("mode", ["count", "binary"])
@pytest.mark.parametrize("terms", [["w0"], ["w5", "w250", "w5"], ["rareword", "w0", "w1", "w2"], ["w299", "nowhere"], ["nowhere"], [], ["w0", "w1", "w2", "w3", "w4", "w5"]])
def test_same_rows_as_a_scan(index, terms, mode):
    rows, it = index
    for k in (1, 10, 5000):
        assert [tuple(r) for r in it.topk(terms, k, mode).collect()] == brute(rows, terms, k, mode)


def test_blocks_below_the_bound_are_not_read(index):
    rows, it = index
    found, read = it.search(["rareword", "w0"], 2)
    assert {r.doc_id for r in found.collect()} == {3002, 3003}
    assert read.count() < it.blocks / 4


def test_only_the_buckets_of_the_terms_are_read(index):
    _, it = index
    rows = it._of("postings", ["w7"])
    assert rows.select("bucket").distinct().count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_frequencies_and_stats(index):
    rows, it = index
    held = Counter(t for _, text in rows for t in set(re.findall(r"[a-z0-9]{2,}", text or "")))
    assert it.frequencies(["w0", "w17", "rareword", "nowhere"]) == {t: held[t] for t in ("w0", "w17", "rareword")}
    assert it.n == len(rows)


def test_stored_index_is_built_once_and_again_after_a_change(spark, tmp_path, monkeypatch):
    made = []
    real = postings.build
    monkeypatch.setattr(postings, "build", lambda *a, **k: made.append(a[1]) or real(*a, **k))
    data, root = f"{tmp_path}/docs", f"{tmp_path}/root"
    df = spark.createDataFrame(corpus(2, 50), "doc_id bigint, text string")
    df.write.parquet(data)
    ask = lambda: [tuple(r) for r in postings.stored(spark.read.parquet(data), root=root).topk(["w0", "w3"], 5).collect()]
    first = ask()
    assert ask() == first and len(made) == 1
    df.withColumn("text", F.concat("text", F.lit(" w3"))).write.mode("overwrite").parquet(data)
    assert ask() != first and len(made) == 2
    scan = search.top(search.bm25(spark.read.parquet(data), "text", ["w0", "w3"], "count"), "score", "doc_id", 5)
    assert ask() == [tuple(r) for r in scan.collect()]


def test_empty_corpus(spark, tmp_path):
    postings.build(spark.createDataFrame([], "doc_id string, text string"), f"{tmp_path}/none")
    it = postings.PostingIndex(spark, f"{tmp_path}/none")
    assert it.topk(["w0"], 3).collect() == [] and it.topk(["w0"], 3).schema["doc_id"].dataType.simpleString() == "string"
