import itertools
import random

import pytest

from brindle.operators import articles

LONG_A = "a" * 30 + " the first part of a long section goes on for a while. " * 8
LONG_B = "b" * 30 + " the second part of it also goes on for quite a while. " * 8
TEXT = f"""AGREEMENT
# ARTICLE 1 RECOGNITION
# ARTICLE 2
## HOURS OF WORK
# ARTICLE 3 VACATIONS
LETTERS OF UNDERSTANDING ... 9
# ARTICLE 1
## RECOGNITION
This preamble stands ahead of the sections and says enough to be kept as a chunk of its own, since it is long.
Section 1. The employer recognizes the union. 7
Section 2. See below.
# ARTICLE 3 is named here
as well as Article 2.
## ARTICLE 2 HOURS OF WORK
Section 1. {LONG_A}
(a) {LONG_A}
(b) short
(c) {LONG_B}
Section 1. <td>Again</td> the same number.
# ARTICLE 3
VACATIONS
All of it in one piece, without any sections.
# LETTERS OF UNDERSTANDING
1. Night Work
Nights are paid as agreed between the parties.
2. Too Short
no
1. Night Work Again
Another letter that has the same number as the first.
"""
WANT = [
    ("art1", "RECOGNITION", "Article 1", "# ARTICLE\n## RECOGNITION\nThis preamble stands"),
    ("art1_sec1", "RECOGNITION", "Article 1, Section 1", "The employer recognizes the union."),
    ("art1_sec2", "RECOGNITION", "Article 1, Section 2", "See below.\n# ARTICLE 3 is named here\nas well as Article 2."),
    ("art2_sec1", "HOURS OF WORK", "Article 2, Section 1", LONG_A.strip()),
    ("art2_sec1_a", "HOURS OF WORK", "Article 2, Section 1(a)", LONG_A.strip()),
    ("art2_sec1_c", "HOURS OF WORK", "Article 2, Section 1(c)", LONG_B.strip()),
    ("art2_sec1_1", "HOURS OF WORK", "Article 2, Section 1", "| Again | the same number."),
    ("art3", "VACATIONS", "Article 3", "# ARTICLE\nVACATIONS\nAll of it in one piece, without any sections."),
    ("lou_1", "Letter of Understanding 1: Night Work", "Letter of Understanding 1", "Nights are paid as agreed between the parties."),
    ("lou_1_1", "Letter of Understanding 1: Night Work Again", "Letter of Understanding 1", "Another letter that has the same number as the first."),
]


def test_chunks_of_a_text_with_contents_and_mentions(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no headings\nSection 1. x"), (5, TEXT)], "id int, text string")
    rows = articles.chunks(df, "id", "text").collect()
    assert {r.id for r in rows} == {1, 5}
    for k in (1, 5):
        got = {r.chunk_id: r for r in rows if r.id == k}
        assert set(got) == {w[0] for w in WANT}
        for chunk_id, title, citation, content in WANT:
            r = got[chunk_id]
            assert (r.title, r.citation) == (title, citation) and " ".join(r.content.split()).startswith(" ".join(content.split())), chunk_id
            if not chunk_id == "art1":
                assert " ".join(r.content.split()) == " ".join(content.split())
    assert {r.doc_type for r in rows if r.chunk_id.startswith("lou")} == {"lou"}


def test_articles_run_to_the_next_heading(spark):
    got = {r.article: r for r in articles.articles(spark.createDataFrame([(1, TEXT)], "id int, text string"), "id", "text").collect()}
    assert [got[k].title for k in (1, 2, 3)] == ["RECOGNITION", "HOURS OF WORK", "VACATIONS"]
    assert got[1].content.startswith("# ARTICLE 1\n## RECOGNITION") and got[1].content.endswith("as well as Article 2.")
    assert got[3].content.endswith("without any sections.")


def slow_run(numbers):
    best = []
    for n in range(len(numbers), 0, -1):
        runs = [c for c in itertools.combinations(range(len(numbers)), n) if all(numbers[a] < numbers[b] for a, b in itertools.pairwise(c))]
        if runs:
            best = list(max(runs))
            break
    return best


@pytest.mark.parametrize("seed", range(3))
def test_runs_against_all_subsequences(seed):
    rng = random.Random(seed)
    for _ in range(300):
        numbers = [rng.randint(1, 6) for _ in range(rng.randint(0, 9))]
        assert articles.last_run(numbers) == slow_run(numbers), numbers
