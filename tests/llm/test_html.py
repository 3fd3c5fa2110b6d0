import random
import time

import pytest

from brindle.llm import html, queries

P = ["The first paragraph has some words, and a comma.", "A second one goes on for a while. It has two sentences.", "The third and last paragraph ends the text of this article."]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n\n".join(P)


def made(seed):
    """A random page and the text that it was made of."""
    from html import escape

    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["alpha", "bêta", "gamma & co", "x < y", "delta,", "end."]) for _ in range(n))
    blocks = [words(rng.randint(3, 60)) + "." for _ in range(rng.randint(1, 12))]
    tag = lambda i: "h1" if not i else rng.choice(["p", "p", "p", "h2", "blockquote", "li"])
    inner = "".join(f"<{t}>{escape(x).replace(' ', rng.choice([' ', '  ', chr(10)]))}</{t}>" for t, x in ((tag(i), x) for i, x in enumerate(blocks)))
    junk = [
        f"<nav><ul><li><a href=/>{words(1)}</a></li></ul></nav>", f"<div class='ad'>{words(9)}</div>", f"<script>{words(9)}</script>", f"<aside><p>{words(20)}</p></aside>",
        f"<div class='newsletter signup'><form>{words(4)}<input></form></div>", f"<section id=comments><p>{words(30)}</p></section>",
    ]
    some = lambda: "".join(rng.choice(junk) for _ in range(rng.randint(0, 3)))
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body>{some()}<article>{inner}</article>{some()}<footer>{words(8)}</footer></body></html>"
    return page, "\n\n".join(" ".join(x.split()) for x in blocks)


def test_made_pages_give_back_their_text():
    for seed in range(300):
        page, text = made(seed)
        assert html.main_text(page) == text, seed


@pytest.mark.parametrize("page", [
    f"<html><body><form id=aspnet><nav><a href=/>Home</a></nav><div>{BODY}</div></form></body></html>",
    f"<html><body><nav>Menu</nav><article>{BODY}</article><footer>Foot, all rights.</footer></body></html>",
    f"<body><header>Head line</header><div class='ad'>Buy this, now. It is cheap, good, and new.</div><article>{BODY}</article>",
    f"<body><div class=sidebar><ul><li>One</li><li>Two</li></ul></div><main>{BODY}</main><div class='comments'><p>First, I think. {P[0] * 9}</p></div></body>",
    f"<article><p>{P[0]}</p><div class='share-prices'><p>{P[1]}</p></div><div class='share-buttons'>Share this</div><p>{P[2]}</p></article>",
    f"<div class='widget'>{BODY}</div><div class='cookie-banner'>We use cookies.</div>",
    f"<div>{BODY.replace('</p>', '')}",
    f"<body><script>var a = '<p>no</p>';</script><style>p {{}}</style>{BODY}<!-- <p>no</p> --></body>",
    f"<body><article class='promo'>{BODY}</article></body>",
    f"<html><body><article><p>{P[0]}</p><p>{P[1]}</p><p>{P[2]}",
])
def test_main_text(page):
    assert html.main_text(page) == WANT


def test_short_article_beside_a_longer_advert():
    page = f"<body><div class='ad'>{P[1]}</div><article><h1>Short one.</h1><p>Short one.</p></article></body>"
    assert html.main_text(page) == "Short one.\n\nShort one."


def test_references_and_white_space():
    page = "<body><i id=x></i><p>a &amp; b&nbsp;c &eacute;&#8364; long enough, yes.</p><p>  two\n\t words <b>bold</b>, here. </p></body>"
    assert html.main_text(page) == "a & b c é€ long enough, yes.\n\ntwo words bold, here."


def test_defined_cases(spark, tmp_path):
    long = "<article>" + "<p>some words, and more.</p>" * 50_000 + "</article>"
    rows = [(1, "u", None, 3), (2, "u", "", 3), (3, "u", "<nav>only menu</nav>", 3), (4, "u", f"<article>{BODY}</article>", 3), (4, "u", f"<article>{BODY}</article>", 3), (5, None, long, 3), (6, "u", "<<<>&", 3)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op10_html_extraction(spark, str(tmp_path)).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert [by_id[i].text for i in (1, 2, 3)] == ["", "", ""] and by_id[4].text == WANT
    assert by_id[5].text.count("some words, and more.") == 50_000


@pytest.mark.parametrize("page", [
    lambda n: "<i><div>" + "<b>" * n + "</i>" * n + "x", lambda n: "<p><table>" + "<b>" * n + "<p>" * n, lambda n: "<li><ul>" + "<b>" * n + "<li>x" * n,
    lambda n: "<div>" * n + "</span>" * n, lambda n: "<b>x" * n + "</b>" * n, lambda n: "<td>" * n + "</i></b>" * n, lambda n: "<!--" * n, lambda n: "<a '" * n, lambda n: "<a \"x'" * n,
    lambda n: "<" * n + "</" * n, lambda n: "<button><p>" + "<i>" * n + "</button><p>" * n,
])
def test_time_grows_with_the_page_alone(page):
    def seconds(n):
        text = page(n)
        began = time.process_time()
        html.main_text(text)
        return time.process_time() - began

    small, large = seconds(10_000), seconds(80_000)
    assert large < 6 and large < 16 * small + 0.3


def test_end_tags_by_walking_the_stack():
    """Which open elements an end tag ends, against a walk down the stack."""
    rng = random.Random(2)
    names = ["div", "p", "b", "i", "li", "ul", "table", "tr", "td", "button", "span"]
    for _ in range(3000):
        page, stack = [], []

        def walk(found, barriers, stack=stack):
            for i in range(len(stack) - 1, -1, -1):
                if found(stack[i]):
                    del stack[i:]
                    return True
                if barriers(stack[i]):
                    return False
            return False

        for _ in range(rng.randint(1, 25)):
            tag = rng.choice(names)
            if rng.random() < 0.4:
                page.append(f"</{tag}>")
                walk(lambda x: x == tag, lambda x: tag not in html.BLOCKS and x in html.BLOCKS)  # noqa: B023
            else:
                page.append(f"<{tag}>")
                if tag in html.BLOCKS:
                    for ends, barriers in (({"p"}, {"button", "table", "object"}), html.IMPLIED.get(tag, (set(), set()))):
                        while walk(lambda x: x in ends, lambda x: x in barriers):  # noqa: B023
                            pass
                stack.append(tag)
        paths, found = html.blocks("".join(page) + "word")
        tags = {number: key[1] for key, number in paths.numbers.items()}

        def named(p, paths=paths, tags=tags):
            out = []
            while p > 0:
                out.append(tags[p])
                p = paths.parent[p]
            return "/".join(reversed(out))

        assert [named(p) for p, _ in found] == ["/".join(stack)]
