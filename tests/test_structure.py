import random
import re

from pyspark.sql import functions as F

from brindle.operators import structure as S


def packed(text, size=800):
    """Paragraphs packed in order, cut where one is too long by itself."""
    out, open_ = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text.replace("\r\n", "\n").replace("\r", "\n").strip())):
        if not p:
            continue
        if not open_:
            open_ = p
        elif len(open_) + 2 + len(p) <= size:
            open_ += "\n\n" + p
        else:
            out.append(open_)
            open_ = p
    out += [open_] if open_ else []
    return [x for c in out for x in ((c[i : i + size].strip() for i in range(0, len(c), size)) if len(c) > size else [c]) if x]


def test_segments(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["pay", "shift", "union", "é"]) for _ in range(n))
    paragraphs = ["\n\n".join(words(rng.randint(1, 300)) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    numbered = "Intro " + words(300) + "\n1. " + words(200) + "\n2) " + words(100) + "\n(3) " + words(50)
    rows = [*paragraphs, numbered, "short", ""]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", S.segments(F.col("t")).alias("s")).orderBy("i").collect()
    for r, text in zip(got, rows):
        if len(text) <= 2000:
            assert [(x.segment, x.text) for x in r.s] == [(None, text)]
        elif text is numbered:
            assert [x.segment for x in r.s] == ["seg_001", "seg_002", "seg_003", "seg_004"] and [x.text.split()[0] for x in r.s] == ["Intro", "1.", "2)", "(3)"]
        else:
            assert [x.text for x in r.s] == packed(text) and all(len(x.text) <= 800 for x in r.s) and r.s[1].citation == "Part 2"


def chunk_lines(lines):
    """Chunks of one contract by walking its lines."""
    article = section = None
    sections = {}
    for at, line in enumerate(lines):
        if m := re.match(r"(?i)article\s+([0-9]+[a-z]?)", line):
            article, section = m[1], None
        elif m := re.match(r"(?i)section\s+(\d+)", line):
            section = m[1]
        if article:
            sections.setdefault((article, section), []).append((at, line))
    out = {}
    for (article, section), held in sections.items():
        if section is None and any(a == article and s for a, s in sections):
            continue
        letters = [i for i, (_, line) in enumerate(held) if re.match(r"\(?[a-z][.)]\s", line)]
        if section and len(letters) >= 2:
            for line_no, (at, line) in enumerate(held):
                before = [i for i in letters if i <= line_no]
                if before:
                    letter = re.match(r"\(?([a-z])", held[before[-1]][1])[1]
                    out.setdefault((article, section, letter), []).append(line)
        else:
            out[article, section, None] = [line for _, line in held]
    return {k: "\n".join(v) for k, v in out.items()}


def test_chunks_by_walking_the_lines(spark):
    rng = random.Random(8)
    makers = [lambda: f"ARTICLE {rng.randint(1, 9)} - Title", lambda: f"Section {rng.randint(1, 5)}. Title. Body", lambda: f"({rng.choice('abc')}) sub", lambda: "plain words", lambda: "plain words"]
    for _ in range(4):
        lines = [rng.choice(makers)() for _ in range(80)]
        df = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "doc int, at int, line string")
        got = {(r.article, r.section, r.part): r.content for r in S.chunks(df, "doc", "at", "line").collect()}
        assert got == chunk_lines(lines)


def test_pages_of_offsets_behind_the_end(spark):
    pages = S.with_offsets(spark.createDataFrame([("d", 1, "abc"), ("d", 2, ""), ("d", 3, "abcde")], "doc string, page int, text string"), "doc", "page", "text", 2)
    asked = spark.createDataFrame([("d", x) for x in (0, 5, 6, 7, 8, 14, 99)], "doc string, at long")
    got = {r["at"]: r.page for r in S.page_at(asked, pages.select("doc", "end", "page"), "doc", "at", "end", "page").collect()}
    assert got == {0: 1, 5: 1, 6: 2, 7: 2, 8: 3, 14: 3, 99: 3}
