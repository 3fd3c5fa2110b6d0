import random
import re

import pytest

from brindle.llm import queries, secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def base(text):
    """The base kinds straight from their definitions."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def brute(text):
    """All rules by re, one after the other."""
    out = []
    for i, rule in enumerate(secrets.RULES):
        for m in re.finditer(f"({rule.pattern})" + (f"|{rule.short}" if rule.short else ""), text, re.ASCII | (re.IGNORECASE if rule.fold else 0)):
            if m[1]:
                out.append((m.start(), i, m.end()))
    return [(secrets.RULES[i].kind, a, b) for a, i, b in sorted(out)]


def texts(seed, n):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    chars = lambda k: "".join(rng.choice("ABCXYZabcxyz0189") for _ in range(k))
    makers = [
        lambda: rng.choice(["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "token=secret", "\"token\""]) + rng.choice(["", "'", "\""]) + rng.choice(["=", ": ", "  =  ", " "]) + rng.choice(["", "\"", "'"]) + chars(rng.randint(0, 9)),
        lambda: "AKIA" + chars(rng.randint(10, 20)).upper(), lambda: hexes(rng.randint(20, 60)), lambda: "gh" + rng.choice("pousx") + "_" + chars(rng.randint(30, 40)),
        lambda: "xoxb-" + chars(rng.randint(10, 20)), lambda: "AIza" + chars(rng.randint(30, 40)), lambda: "eyJ" + chars(9) + ".eyJ" + chars(rng.randint(5, 12)) + rng.choice(["", ".", ".x"]),
        lambda: "-----BEGIN " + rng.choice(["RSA ", "", "PRIVATE "]) + "PRIVATE KEY-----" + rng.choice(["", "\n" + chars(30) + "\n-----END PRIVATE KEY-----"]),
        lambda: rng.choice([" ", "é", "\n", "🙂", "=", ":", "AKIA", "gh", "eyJ", "token", "a plain word ", ""]),
    ]
    return ["".join(rng.choice(makers)() + rng.choice(["", " ", "é "]) for _ in range(rng.randint(0, 8))) for _ in range(n)]


def test_spans_match_the_patterns_one_by_one():
    s = secrets.scanner(secrets.RULES)
    found = 0
    for text in texts(1, 6000):
        got = s.spans(text)
        assert got == brute(text), text
        assert [g for g in got if g[0] in secrets.BASE_KINDS] == base(text), text
        found += len(got)
    assert found > 5000


def test_short_values_use_up_what_they_cover():
    s = secrets.scanner(secrets.RULES)
    assert s.spans("token=password: abcdefgh") == base("token=password: abcdefgh") == [("assign", 0, 14)]
    assert s.spans("token=token: abcdefgh") == base("token=token: abcdefgh") == []
    assert s.spans("é secret=abc; secret=abcdef") == [("assign", 14, 27)]


def test_automata_are_minimal_and_small():
    s = secrets.scanner(secrets.RULES)
    a = s.whole
    n = len(a.labels)
    assert n < 1200 and a.dead >= 0
    # No two states have the same label and the same way on.
    assert len({(a.labels[k], *a.table[k * 256 : k * 256 + 256]) for k in range(n)}) == n


def test_heads_of_changing_width_and_unknown_syntax_are_refused():
    with pytest.raises(ValueError):
        secrets.Scanner((secrets.Rule("x", ("ab?",), "ab?c"),))
    with pytest.raises(ValueError):
        secrets.Scanner((secrets.Rule("x", ("a",), r"a(?=b)"),))


def test_defined_cases(spark):
    secret = "password=abcdefgh"
    rows = [(1, None, 7), (2, "", 7), (3, secret, 7), (3, secret, 8), (4, "x " * 400_000 + secret, 7), (None, secret, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind int").withColumn("found", secrets.scan(secrets.F.col("text")))
    got = sorted(((r.doc_id, r.kind, [(f.kind, f.start, f.end) for f in r.found]) for r in df.collect()), key=str)
    one = [("assign", 0, 17)]
    assert got == sorted([(1, 7, []), (2, 7, []), (3, 7, one), (3, 8, one), (4, 7, [("assign", 800_000, 800_017)]), (None, 7, one)], key=str)
    assert spark.createDataFrame([], "text string").select(secrets.scan(secrets.F.col("text"))).count() == 0
    clean = df.filter("doc_id = 3").select(secrets.redact("text", "found").alias("t")).first()
    assert clean.t == "[SECRET]"


def test_query(spark, tmp_path):
    rows = list(enumerate(texts(2, 300)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    for r in queries.op8_secret_scan(spark, str(tmp_path)).collect():
        want = base(rows[r.doc_id][1])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, *_ in want) for kind in secrets.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(rows[r.doc_id][1]))


@pytest.mark.parametrize("unit", ["eyJ", "eyJabcdefgh.", "eyJabcdefgh.eyJ", "é eyJ", "token ", "token= ", "token" + " " * 5000, "AKIA", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----abc ", "gho_xox", "0123456789abcdef", "é token=abcdefgh "])
def test_time_grows_with_the_text_alone(unit):
    """A megabyte of heads that fail late, or of spans among other characters than ASCII."""
    import time

    s = secrets.scanner(secrets.RULES)

    def seconds(size):
        text = unit * (size // len(unit))
        best = 1e9
        for _ in range(2):
            began = time.process_time()
            s.spans(text)
            best = min(best, time.process_time() - began)
        return best

    small, large = seconds(250_000), seconds(1_000_000)
    assert large < 4 and large < 8 * small + 0.2


def test_reads_in_vain_lose_no_match():
    """Small alphabets of heads, tails and dots, so that many starts share a tail that fails or, later, doesn't."""
    rng = random.Random(5)
    rules = (secrets.Rule("signed", ("eyJ",), r"eyJ[a-zA-Z]{2,}\.eyJ[a-zA-Z]{2,}(?:\.[a-z]+)?"), secrets.Rule("pair", ("ab",), r"ab(?:ab|c)*d(?:[a-c]*e)?"), secrets.Rule("quoted", ("k=",), r"k=[a-z]*!", r"k=[a-z]{1,3}"))
    s = secrets.Scanner(rules)
    units = ["eyJ", "eyJab", ".", "ab", "abc", "d", "e", "x", "k=", "!", "abab" * 40, "eyJ" * 40, "k=" + "a" * 90, "c" * 70, "é"]
    hits = 0
    for _ in range(500):
        text = "".join(rng.choice(units) for _ in range(rng.randint(1, 9)))
        want = []
        for i, rule in enumerate(rules):
            at = 0
            while at < len(text):  # leftmost longest, by definition
                ends = list(range(len(text), at, -1)) if text.startswith(rule.heads[0], at) else []
                whole = next((e for e in ends if re.fullmatch(rule.pattern, text[at:e])), None)
                short = next((e for e in ends[-8:] if rule.short and re.fullmatch(rule.short, text[at:e])), None) if not whole else None
                if whole:
                    want.append((at, i, whole))
                at = whole or short or at + 1
        assert s.spans(text) == [(rules[i].kind, a, b) for a, i, b in sorted(want)], text
        hits += len(want)
    assert hits > 50
