import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import fingerprints, merkle, queries, variants
from brindle.llm.common import Scratch

CLASHING = "tree string, at int, leaf int, root string, word int, near string, part int, edge string, held int, digest int"
CLASHES = ("t", 1, 2, "r", 3, "n", 4, "e", 5, 6)


def write(spark, path, rows, schema="doc_id bigint, source string, lang string, n_chars bigint, text string"):
    df = spark.createDataFrame([(*r, *CLASHES) for r in rows], f"{schema}, {CLASHING}")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")


def documents(seed, sizes):
    """Rows of sources of the given sizes, with nulls, repeated ids and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Plain Text", "lower only", "é Ü 🙂", " ".join(rng.choice("Ab cd EF gh".split()) for _ in range(9))])
            rows.append((rng.choice([None, rng.randrange(10**6), rng.randrange(10**6), rng.randrange(50)]), source, rng.choice([None, "en", "de"]), rng.choice([None, 3, -1]), text))
    return rows + rows[:5]


# ---- manifests ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tree(leaves):
    """All levels of a tree, the leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, at):
    """(before, behind) at each level."""
    out = []
    for level in levels[:-1]:
        begin = at // 16 * 16
        out.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + 16])))
        at //= 16
    return out


def brute_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for at, r in enumerate(by_source[s]):
            path = siblings(trees[s], at) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], lowered(r[4]))) if bad else leaf(r)
            for left, right in path:
                node = h(left, node, right)
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*(left + right for left, right in path)), node, node == root))
    return out


SIZES = [
    {"a": 1}, {"a": 17}, {None: 3, "": 1, "b": 300, "é": 2}, {f"s{i}": 1 for i in range(40)}, {"hot": 700, **{f"s{i}": i % 4 + 1 for i in range(20)}},
]


@pytest.fixture
def many_parts(spark):
    """Ranges that Spark doesn't put together again."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("fan", [2, 16])
@pytest.mark.parametrize("sizes", SIZES)
def test_manifest_against_trees_built_at_once(spark, tmp_path, monkeypatch, many_parts, sizes, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = documents(len(sizes), sizes)
    write(spark, tmp_path, rows)
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [])
    assert queries.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_sums_of_forests_are_associative():
    leaves = [h(str(i)) for i in range(1000)]
    want = tree(leaves)[-1][0]
    for seed in range(5):
        rng = random.Random(seed)
        parts = []
        order = list(range(1000))
        rng.shuffle(order)
        for k in range(0, 1000, 90):
            forest = merkle.Forest(1)
            for i in order[k : k + 90]:
                forest.add(0, 0, i, 1000, leaves[i])
            parts.append(forest)
        while len(parts) > 1:
            rng.shuffle(parts)
            a, b = parts.pop(), parts.pop()
            for t, level, at, n, node, _ in list(b.nodes()):
                a.add(t, level, at, n, node)
            parts.append(a)
        assert parts[0].root == want and not parts[0].open


def test_open_nodes_of_a_range_are_few():
    forest = merkle.Forest(3)
    for i in range(12_345, 98_765):
        forest.add(1, 0, i, 1_000_000, str(i))
    assert sum(1 for _ in forest.nodes()) <= 2 * 15 * 5


# ---- spelling variants ----


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            x = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if x % 199 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in words:
        found = [x for x in words if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
        out.append((w, words[w], len(found), form[w], words.get(form[w])))
    rooted = []
    for w, *rest in out:
        x = w
        while form[x]:
            x = form[x]
        rooted.append((w, *rest, x))
    return rooted


def spelled(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "ÀÉxyzw", "ÿ×÷abc"]

    def odd(w, times):
        for _ in range(times):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdeéÿ") + w[i:], w[:i] + rng.choice("abcdeéÿ") + w[i + 1 :]])
        return w

    pool = [(w, 150) for w in base] + [(odd(w, 1), 20) for w in base for _ in range(4)] + [(odd(w, 2), 3) for w in base for _ in range(4)]
    words, weights = zip(*pool, strict=True)
    return [(i, " ".join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(words, weights, k=60))) for i in range(n)]


def test_variants_against_all_pairs(spark, tmp_path):
    rows = [*spelled(1, 300), (None, "secret " * 7 + "secrets"), (7, None), (8, ""), (9, "1234 ab cd-ef")] + spelled(1, 3)
    write(spark, tmp_path, rows, "doc_id bigint, text string")
    got = queries.op12_spelling_variants(spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute_variants(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r[3] is not None for r in want) > 20 and any(r[3] != r[5] for r in want if r[3])


def test_variants_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [], "doc_id bigint, text string")
    assert queries.op12_spelling_variants(spark, str(tmp_path)).collect() == []


def test_hashes_of_neighbours_are_those_of_their_texts():
    alphabet = "abcéÿ"
    letters = variants._points([alphabet], len(alphabet))[0]
    for w in ("abcabc", "aaaaaa", "écÿabca"):
        other = set()
        for kind, i, hashes in variants.neighbour_hashes(variants._points([w], len(w)), letters):
            for j, c in enumerate([""] if kind == "delete" else alphabet):
                text = w[:i] + c + w[i + (kind != "insert") :]
                other.add(text)
                assert np.ravel(hashes)[j] == variants.word_hashes(variants._points([text], len(text)))[0]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in alphabet for k in (0, 1) if i + k <= len(w)}
        assert other == want


def test_full_bitmap_gives_the_same_pairs(spark, monkeypatch):
    """A bitmap too small to tell anything apart costs time, not rows."""
    words = variants.vocabulary(spark.createDataFrame(spelled(2, 100), "doc_id bigint, text string"))
    scratch = Scratch(spark)
    words = scratch.table(words, "vocabulary")
    got = variants.near_words(words, spark.sparkContext, Scratch(spark)).collect()
    monkeypatch.setattr(variants, "_bitmap", lambda words, bits: bytes([255]) * (1 << bits >> 3))
    again = variants.near_words(words, spark.sparkContext, Scratch(spark)).collect()
    assert got and sorted(got) == sorted(again)


def test_long_chains_are_followed_to_their_end(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(70)] + [("x", "w3")], "word string, form string")
    got = {r.word: r.root for r in variants.follow(links, Scratch(spark)).collect()}
    assert set(got.values()) == {"w70"} and len(got) == 71


# ---- fingerprints ----


def slow_digest(text):
    """The digest by its definition, a window at a time."""
    data = text.encode()
    counts = [0] * 256
    for i in range(len(data)):
        for k, (b, c) in enumerate(fingerprints.TRIPLETS):
            if i + c < len(data):
                x = ((data[i] | data[i + b] << 8 | data[i + c] << 16 | k << 24) * 0x9E3779B1) & 0xFFFFFFFF
                counts[((x ^ x >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 24] += 1
    ranked = sorted(counts)
    q = [ranked[63], ranked[127], ranked[191]]
    classes = [sum(c > x for x in q) for c in counts]
    head = [zlib.crc32(data) % 256, min(255, int(4 * np.log2(len(data) + 1))), (15 * q[0] // q[2]) * 16 + 15 * q[1] // q[2] if q[2] else 0]
    return bytes(head + [sum(classes[i + j] << 2 * j for j in range(4)) for i in range(0, 256, 4)]).hex(), classes


def slow_likeness(a, b):
    (x, cx), (y, cy) = slow_digest(a), slow_digest(b)
    x, y = bytes.fromhex(x), bytes.fromhex(y)
    steps = sum((0, 1, 2, 6)[abs(p - q)] for p, q in zip(cx, cy, strict=True))
    steps += 4 * min(12, abs(x[1] - y[1])) + 2 * min(12, abs(x[2] // 16 - y[2] // 16) + abs(x[2] % 16 - y[2] % 16)) + (x[0] != y[0])
    return max(0.0, 1 - steps / 416)


def sentences(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_fingerprints_against_the_definition(spark, tmp_path, many_parts):
    texts = sentences(3, 60)
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, None), (6, ""), (6, "x"), (6, "x"), (8, "ab🙂é"), (9, "word " * 70_000)]
    write(spark, tmp_path, rows, "doc_id bigint, text string")
    got = queries.op11_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    hashed = {(r.t, r.h) for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = dict(hashed)
    line = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]]))
    want = []
    for k, (doc_id, text) in enumerate(line):
        following = line[(k + 1) % len(line)][1]
        edited = fingerprints.edited_text(text, following)
        assert edited == text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        want.append((doc_id, len(text), h(edited), slow_digest(text)[0], slow_digest(edited)[0], slow_likeness(text, edited), slow_likeness(text, following)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_fingerprints_of_little(spark, tmp_path):
    write(spark, tmp_path, [], "doc_id bigint, text string")
    assert queries.op11_document_fingerprints(spark, str(tmp_path)).collect() == []
    write(spark, tmp_path / "one", [(3, "only one text here")], "doc_id bigint, text string")
    (r,) = queries.op11_document_fingerprints(spark, str(tmp_path / "one")).collect()
    assert (r.n_chars, r.near_next) == (18, 1.0) and r.edited_sha256 == h("only one text " + "only")


def test_pieces_of_long_texts_count_like_the_whole(monkeypatch):
    text = sentences(4, 1)[0] * 3
    whole = fingerprints.digest(text)
    for piece in (5, 64, 1000):
        monkeypatch.setattr(fingerprints, "PIECE", piece)
        assert fingerprints.digest(text) == whole


def test_likeness_parts_edits_from_other_texts(spark):
    texts = [t for t in sentences(5, 120) if len(t) > 200]
    near = [fingerprints.likeness_of(fingerprints.digest(t), fingerprints.digest(fingerprints.edited_text(t, texts[i - 1]))) for i, t in enumerate(texts)]
    far = [fingerprints.likeness_of(fingerprints.digest(t), fingerprints.digest(texts[i - 1])) for i, t in enumerate(texts)]
    assert sum(a > b for a, b in zip(near, far, strict=True)) >= 0.98 * len(texts) and np.median(near) > 0.6 > 0.5 > np.median(far)
    df = spark.createDataFrame([("a b c",), ("a b c",), (None,)], "t string").select(fingerprints.fingerprint(F.col("t")).alias("f"))
    assert [r.x for r in df.select(fingerprints.likeness(F.col("f"), F.lit(fingerprints.digest("a b c"))).alias("x")).collect()][:2] == [1.0, 1.0]
