import random
import re
from difflib import unified_diff

import pytest

from brindle.operators import diffs


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        pool = [f"line {i}" for i in range(rng.choice([2, 5, 40]))] + ["", "the end"]
        a = [rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 30, 60]))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b) + 1)
            match rng.randrange(4):
                case 0:
                    b[i:i] = [f"new {rng.randrange(9)}"]
                case 1:
                    b[i : i + rng.randint(1, 5)] = []
                case 2:
                    b[i : i + 1] = [rng.choice(pool)]
                case _:
                    b = b[i:] + b[:i] if rng.random() < 0.3 else b
        out.append((k, "\n".join(a) + ("\n" if a else ""), "\r\n".join(b)))
    return [*out, (n, None, "a\nb"), (n + 1, "a\nb", None), (n + 2, "", ""), (n + 3, "same", "same\n")]


def split(text):
    return (text or "").splitlines()


@pytest.fixture(scope="module")
def cases(spark):
    rows = texts(1, 80)
    script = diffs.line_diff(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").cache()
    return rows, script


def test_script_gives_both_texts(cases):
    rows, script = cases
    by_id = {}
    for r in sorted(script.collect(), key=lambda r: (r.id, r.place)):
        by_id.setdefault(r.id, []).append(r)
    for k, a, b in rows:
        found = by_id.get(k, [])
        assert [r.line for r in found if r.op != "+"] == split(a) and [r.line for r in found if r.op != "-"] == split(b)
        assert [r.place for r in found] == list(range(len(found)))
        i = j = 0
        for r in found:
            assert (r.i, r.j) == (i, j)
            i, j = i + (r.op != "+"), j + (r.op != "-")


def apply_hunks(base, found, reverse=False):
    """The other text, from one text and its hunks."""
    out, at = [], 0
    for header, body in found:
        m = re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", header)
        begin, n = (int(m[3]), m[4]) if reverse else (int(m[1]), m[2])
        n = 1 if n is None else int(n)
        begin = begin if n == 0 else begin - 1
        out += base[at:begin]
        gone, come = ("+", "-") if reverse else ("-", "+")
        assert [x[1:] for x in body if x[0] != come] == base[begin : begin + n]
        out += [x[1:] for x in body if x[0] != gone]
        at = begin + n
    return out + base[at:]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_rebuild_one_text_from_the_other(cases, context):
    rows, script = cases
    by_id = {}
    for r in sorted(diffs.hunks(script, "id", context).collect(), key=lambda r: (r.id, r.hunk)):
        by_id.setdefault(r.id, []).append((r.header, r.lines))
    for k, a, b in rows:
        found = by_id.get(k, [])
        assert apply_hunks(split(a), found) == split(b) and apply_hunks(split(b), found, True) == split(a)
        assert bool(found) == (split(a) != split(b))


def test_unified_text_of_plain_edits(spark):
    """Where the lines differ from one another, there is one shortest script, and its text is the usual one."""
    rng = random.Random(4)
    rows = []
    for k in range(30):
        a = [f"line {i}" for i in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b) + 1)
            b[i:i] = [f"new {k} {rng.random()}"]
        rows.append((k, "\n".join(a), "\n".join(b)))
    script = diffs.line_diff(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b")
    got = {r.id: r.excerpt for r in diffs.unified(diffs.hunks(script, "id", 1), "id", 12).collect()}
    for k, a, b in rows:
        want = list(unified_diff(a.splitlines(), b.splitlines(), "base", "effective", lineterm="", n=1))[:12]
        assert got.get(k, "") == "\n".join(want)


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shortest_edits_and_increasing_runs():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        kept = diffs.common_lines(a, b)
        assert len(kept) == longest(a, b) and all(a[x] == b[y] for x, y in kept)
        assert kept == sorted(set(kept)) and len({x for x, _ in kept}) == len({y for _, y in kept}) == len(kept)
        places = rng.sample(range(30), rng.randint(0, 12))
        run = diffs.increasing(places)
        assert [places[k] for k in run] == sorted(places[k] for k in run) and len(run) == longest(places, sorted(places))
    assert diffs.common_lines(list("abcdef"), list("uvwxyz"), most=3) == []
