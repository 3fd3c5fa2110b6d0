"""Main text of web pages by tag-path ratios.

Every text block of a page belongs to a root-to-leaf tag path. Per path, text length and punctuation are summed and
divided by the number of its blocks; the ratios are smoothed along the page, weighed by what tags and class names say
(menus, footers and comments weigh nothing, article and main more), fused upwards, so that the container in which most
of the page's score gathers lends its score to all its paths, and held against a threshold. Blocks on the paths above
it are the content.

Forms and names of adverts, sidebars, notices and the like are doubts: on a page without an article, they only count
against a container that holds less than HALF of the text, and never where no text would be left: a layout within a
form, or a body of an odd name, is no boilerplate. Within an article, each word of such a name must tell of boilerplate.

Defined results: a null page has no text (empty string); missing end tags and a page that breaks off are read as
browsers do; white space within a block is one space, blocks are joined by an empty line; repeated rows and further
columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that begin a block, that have no end tag, whose text is none of the page's, and boilerplate.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "xmp", "noembed", "noframes", "select", "math")
BOILERPLATE = frozenset("nav footer aside menu dialog button title head".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert disclaimer popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers "
    "widget copyright legal pagination pager comment comments disqus replies reply respond discussion tags search skip contentinfo complementary".split()
)
#: Words that say nothing by themselves when they stand beside one of those names.
PLAIN = frozenset(
    "article post page site box block wrapper wrap list bar link links button buttons section area container inner item items posts unit slot row "
    "col group panel form content media icons icon top bottom left right".split()
)
COMMENTS = frozenset("comment comments disqus replies reply respond discussion".split())
#: An end that a start tag implies: these open elements end, unless one of the others stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
CONTENT_WEIGHT, SMOOTHING, GATHERED, LENT, THRESHOLD = 4.0, (0.25, 0.5, 0.25), 0.8, 0.5, 0.2
HALF = 0.5

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。、،]")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


class _Paths:
    """Tag paths as a tree: number, parent and weight of each; ``doubted`` where only a form or a name speaks against it."""

    def __init__(self):
        self.parent, self.weight, self.inside, self.doubted = [-1], [1.0], [False], [False]
        self.content, self.numbers = [False], {}

    def below(self, parent: int, tag: str, attributes: str) -> int:
        found = [a or b or c for a, b, c in _NAMED.findall(attributes)] if "=" in attributes else []
        key = (parent, tag, *found)
        if (number := self.numbers.get(key)) is not None:
            return number
        tokens = [frozenset(_WORD.findall(token)) for a in found for token in a.lower().split()]
        names = frozenset().union(*tokens)
        weight, inside, doubted, content = self.weight[parent], self.inside[parent], False, False
        named = any(t & NAMES and t <= NAMES | PLAIN for t in tokens) if inside else bool(names & NAMES)
        if names & COMMENTS and tag not in ("html", "body"):
            weight = 0.0
        elif tag in ("article", "main") or "main" in names and "role" in attributes:
            content, inside = True, True
            weight = 0.0 if self.inside[parent] and not weight else CONTENT_WEIGHT
        elif tag in BOILERPLATE or tag == "header" and not inside:
            weight = 0.0
        elif tag not in ("html", "body"):
            doubted = named or tag == "form"
        self.parent.append(parent)
        self.weight.append(weight)
        self.inside.append(inside)
        self.doubted.append(doubted)
        self.content.append(content)
        self.numbers[key] = len(self.parent) - 1
        return len(self.parent) - 1

    def settle(self, found: list[tuple[int, str]]) -> None:
        """Takes the weight from doubted containers that hold less than HALF of the text that weighs anything."""
        held = [0] * len(self.parent)
        for p, text in found:
            held[p] += len(text) if self.weight[p] else 0
        for p in range(len(held) - 1, 0, -1):
            held[self.parent[p]] += held[p]
        told = any(c and w and n for c, w, n in zip(self.content, self.weight, held, strict=True))
        gone = [False] * len(held)
        for p in range(1, len(held)):
            up = self.parent[p]
            # An article ends what was doubted outside of it.
            gone[p] = gone[up] and not (self.content[p] and not self.inside[up]) or self.doubted[p] and (told or held[p] < HALF * held[0])
        if any(self.weight[p] and not gone[p] for p, _ in found):
            self.weight = [0.0 if g else w for g, w in zip(gone, self.weight, strict=True)]


def blocks(html: str) -> tuple[_Paths, list[tuple[int, str]]]:
    """The page's paths and its text blocks, as (path, text), in page order."""
    paths, out = _Paths(), []
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    at_path = 0
    at, end, started = 0, len(html), False

    def flush() -> None:
        if pieces:
            raw = "".join(pieces)
            if text := " ".join((unescape(raw) if "&" in raw else raw).split()):
                out.append((at_path, text))
            pieces.clear()

    # Where each name stands in the stack, and where blocks do: what an end tag ends is found without walking the stack.
    where: defaultdict[str, list[int]] = defaultdict(list)
    block_at: list[int] = []

    def push(tag: str, path: int) -> None:
        where[tag].append(len(stack))
        if tag in BLOCKS:
            block_at.append(len(stack))
        stack.append((tag, path))

    def pop_to(i: int) -> None:
        for name, _ in stack[i:]:
            where[name].pop()
        while block_at and block_at[-1] >= i:
            block_at.pop()
        del stack[i:]

    def newest(names: set[str]) -> int:
        return max((where[x][-1] for x in names if where[x]), default=0)

    def close(names: set[str], barriers: set[str]) -> None:
        while (i := newest(names)) > newest(barriers):
            pop_to(i)

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            if html[at:].strip():
                at_path = at_path if started and pieces else stack[-1][1]
                pieces.append(html[at:])
            break
        if m.start() > at:
            between = html[at : m.start()]
            started = bool(pieces) and started
            if not started:
                at_path = stack[-1][1]
            pieces.append(between)
            started = started or not between.isspace()
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] if m[2] else m[4], (m[3] if m[2] else m[6]) or ""
        if closing:
            if tag in BLOCKS:
                flush()
            i = newest({tag})
            if i and (tag in BLOCKS or not block_at or block_at[-1] < i):
                pop_to(i)
            continue
        if tag in _RAW_END:
            if not attributes.endswith("/") or tag != "svg":
                over = _RAW_END[tag].search(html, at)
                at = over.end() if over else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            close({"p"}, {"button", "table", "object"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag == "body":
                close({"head"}, set())
        push(tag, paths.below(stack[-1][1], tag, attributes))
    flush()
    return paths, out


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by empty lines."""
    if not html:
        return ""
    paths, found = blocks(html)
    if not found:
        return ""
    paths.settle(found)
    n = len(paths.parent)
    length, marks, count = [0] * n, [0] * n, [0] * n
    for p, text in found:
        length[p] += len(text)
        marks[p] += len(_PUNCTUATION.findall(text))
        count[p] += 1
    ratio = [length[p] / count[p] * (1 + marks[p] / count[p]) if count[p] else 0.0 for p in range(n)]

    # Smoothed along the page: a short heading between long paragraphs gains, a stray line in a menu doesn't.
    line = [ratio[p] for p, _ in found]
    padded = [line[0], *line, line[-1]]
    smooth = [sum(w * padded[i + j] for j, w in enumerate(SMOOTHING)) for i in range(len(line))]
    own, total, below = [0.0] * n, [0.0] * n, [0.0] * n
    for (p, _), s in zip(found, smooth, strict=True):
        own[p] = max(own[p], s * paths.weight[p])
        total[p] += s * paths.weight[p]
    for p in range(n - 1, 0, -1):  # parents have smaller numbers
        total[paths.parent[p]] += total[p]
        below[paths.parent[p]] += total[p]
    if not total[0]:
        return ""

    # The deepest container whose paths gather most of the score lends to all of them.
    best = 0
    for p in range(1, n):
        if paths.parent[p] == best and below[p] >= GATHERED * total[0]:
            best = p
    under = [False] * n
    under[best] = True
    for p in range(best + 1, n):
        under[p] = under[paths.parent[p]]
    top = max(own)
    fused = [max(own[p], LENT * top if under[p] and paths.weight[p] else 0.0) for p in range(n)]
    return "\n\n".join(text for p, text in found if paths.weight[p] and fused[p] >= THRESHOLD * top)


def extract(html: Column) -> Column:
    """string: the main text of a page, empty if there is none."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return F.arrow_udf(run, "string")(html)
