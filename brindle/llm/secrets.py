"""Secret scans with one combined deterministic automaton.

The rules' patterns are parsed and joined into one nondeterministic automaton with the rules as accepting labels, made
deterministic by subset construction and minimised by partition refinement; transitions are arrays of 256 states by
byte. Two automata come of it. The first one searches: it holds the rules' heads (a rule's first bytes, of fixed
width) and reads each byte of a text once, for all rules; where a head ends, a match may begin. The second one holds
the whole rules and starts there: it tells the longest match of each rule, or that there is none. Whole rules in
the searching automaton would multiply their counted tails with one another, since each may begin within any other.
Matches of a rule are taken leftmost first and don't overlap.

A text costs time in proportion to its length, whatever it holds: where a rule has read on behind its last match in vain,
its states are remembered at every STEP-th byte, and a later start that comes to the same state there gives up.

Defined results: a null text counts as empty; spans count code points, with exclusive ends; repeated rows and
further columns pass through.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A pattern, and the fixed-width ``heads`` one of which each match begins with.

    ``short``: a pattern whose matches are no finding but use up what they cover, where ``pattern`` doesn't match.
    ``fold``: letters in either case.
    """

    kind: str
    heads: tuple[str, ...]
    pattern: str
    short: str | None = None
    fold: bool = False


_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: The three base kinds, then the further ones, in the order in which spans of equal start are listed.
RULES = (
    Rule("assign", _KEYWORDS, _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}", _ASSIGN + r"[A-Za-z0-9+/_.=-]{1,5}", fold=True),
    Rule("access", ("AKIA",), r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", (r"[0-9a-f]{24}",), r"[0-9a-f]{24,}"),
    Rule("key_block", ("-----BEGIN ",), r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    Rule("git_token", (r"gh[pousr]_",), r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", (r"xox[abprs]-",), r"xox[abprs]-[A-Za-z0-9-]{16,}"),
    Rule("cloud_key", ("AIza",), r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("signed_token", ("eyJ",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: States of reading in vain are remembered at multiples of it, from reads of LONG bytes on.
STEP, LONG = 4, 64


class _Nfa:
    """States with edges on sets of bytes and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree: Iterable, at: int, fold: bool) -> int:
        """Adds a parsed pattern behind a state and returns its end."""
        for op, value in tree:
            name = str(op)
            if name in ("LITERAL", "IN", "NOT_LITERAL", "ANY"):
                end = self.state()
                self.edges[at].append((_bytes_of(name, value, fold), end))
                at = end
            elif name == "SUBPATTERN":
                at = self.add(value[-1], at, fold)
            elif name == "BRANCH":
                end = self.state()
                for branch in value[1]:
                    self.empty[self.add(branch, at, fold)].append(end)
                at = end
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                least, most, body = value
                for _ in range(least):
                    at = self.add(body, at, fold)
                if most == sre.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(end)
                        at = self.add(body, at, fold)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"a rule can't hold {name}")
        return at


def _bytes_of(name: str, value, fold: bool) -> frozenset[int]:
    if name == "LITERAL":
        found = {value}
    elif name == "ANY":
        found = set(range(256)) - {10}
    elif name == "NOT_LITERAL":
        found = set(range(256)) - {value}
    else:
        found, negate = set(), False
        for op, x in value:
            if str(op) == "NEGATE":
                negate = True
            elif str(op) == "LITERAL":
                found.add(x)
            elif str(op) == "RANGE":
                found |= set(range(x[0], x[1] + 1))
            elif str(op) == "CATEGORY" and str(x) == "CATEGORY_SPACE":
                found |= set(b" \t\n\r\f\v")
            else:
                raise ValueError(f"a rule's class can't hold {op}")
        found = set(range(256)) - found if negate else found
    if fold:
        found |= {b ^ 32 for b in found if chr(b & ~32) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" and b < 128}
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[s * 256 + byte]`` is the next state; ``labels[s]`` the bit set of patterns that match where s is entered.

    State 0 is the start. ``dead`` is the state that nothing leaves and that matches nothing, -1 if there is none.
    """

    table: list[int]
    labels: list[int]
    dead: int

    def linked_rows(self) -> list:
        """The start row of linked rows: row[byte] is the next row, row[256] its labels."""
        rows: list[list] = [[] for _ in self.labels]
        for s, row in enumerate(rows):
            row.extend(rows[t] for t in self.table[s * 256 : s * 256 + 256])
            row.append(self.labels[s])
        return rows[0]


def compile_patterns(patterns: list[tuple[str, bool]], search: bool) -> Automaton:
    """Subset construction and minimisation of (pattern, fold) pairs; with ``search``, matches may begin anywhere."""
    nfa = _Nfa()
    start = nfa.state()
    accepts: dict[int, int] = {}
    for i, (pattern, fold) in enumerate(patterns):
        begin = nfa.state()
        nfa.empty[start].append(begin)
        accepts[nfa.add(sre.parse(pattern), begin, fold)] = 1 << i

    def closure(states: Iterable[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    # Bytes that no edge tells apart are one class.
    sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    kinds: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(kinds.values())
    base = closure([start])
    numbers, table, order = {base: 0}, [], [base]
    for subset in order:  # grows meanwhile
        row = []
        for members in classes:
            b = members[0]
            reached = closure({t for s in subset for bytes_, t in nfa.edges[s] if b in bytes_} | ({start} if search else set()))
            if reached not in numbers:
                numbers[reached] = len(order)
                order.append(reached)
            row.append(numbers[reached])
        table.append(row)
    labels = []
    for subset in order:
        bits = 0
        for s in subset:
            bits |= accepts.get(s, 0)
        labels.append(bits)

    # States are equal until their labels or the blocks they lead to differ.
    block, count = labels[:], 0
    while True:
        keys: dict[tuple, int] = {}
        block = [keys.setdefault((block[s], *(block[t] for t in table[s])), len(keys)) for s in range(len(order))]
        if len(keys) == count:
            break
        count = len(keys)
    of_byte = [0] * 256
    for c, members in enumerate(classes):
        for b in members:
            of_byte[b] = c
    chosen = {block[s]: s for s in reversed(range(len(order)))}
    table = [block[table[chosen[k]][of_byte[b]]] for k in range(count) for b in range(256)]
    labels = [labels[chosen[k]] for k in range(count)]
    dead = next((k for k in range(count) if not labels[k] and set(table[k * 256 : k * 256 + 256]) == {k}), -1)
    return Automaton(table, labels, dead)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        heads = [(i, head) for i, rule in enumerate(rules) for head in rule.heads]
        self.first = compile_patterns([(head, rules[i].fold) for i, head in heads], search=True).linked_rows()
        # Where a head's bit is set, its rule may have begun so many bytes before.
        self.heads = [(i, _width(head)) for i, head in heads]
        whole = [(i, False, rule.pattern) for i, rule in enumerate(rules)] + [(i, True, rule.short) for i, rule in enumerate(rules) if rule.short]
        self.whole = compile_patterns([(pattern, rules[i].fold) for i, _, pattern in whole], search=False)
        self.bits = [(sum(1 << j for j, (k, short, _) in enumerate(whole) if k == i and not short), sum(1 << j for j, (k, short, _) in enumerate(whole) if k == i and short)) for i in range(len(rules))]

    def _match(self, data: bytes, start: int, rule: int, vain: _Vain) -> tuple[int, bool]:
        """(end, found) of the longest match of a rule that begins there; the end is the start if there is none."""
        table, labels, dead = self.whole.table, self.whole.labels, self.whole.dead
        bits, short = self.bits[rule]
        either, known = bits | short, vain.known
        s, end, found, used, last = 0, start, False, start, start
        at = start
        for at in range(start, len(data)):
            s = table[s << 8 | data[at]]
            if s == dead:
                break
            if labels[s] & either:
                last = at
                if labels[s] & bits:
                    end, found = at + 1, True
                else:
                    used = at + 1
            elif known and at % STEP == 0 and vain.holds(at, s):
                break
        if at - last >= LONG:
            s = 0
            for k in range(start, at):
                s = table[s << 8 | data[k]]
                if k > last and k % STEP == 0:
                    vain.add(k, s)
        return (end, True) if found else (used, False)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        data, row = text.encode("utf-8", "surrogatepass"), self.first
        over = [0] * len(self.rules)
        vain = [_Vain(len(data)) for _ in self.rules]
        found = []
        for at, b in enumerate(data, 1):
            row = row[b]
            if row[256]:
                bits = row[256]
                while bits:
                    i, width = self.heads[(bits & -bits).bit_length() - 1]
                    bits &= bits - 1
                    if at - width >= over[i]:
                        end, hit = self._match(data, at - width, i, vain[i])
                        over[i] = max(over[i], end)
                        if hit:
                            found.append((at - width, i, end))
        found.sort()
        if len(data) != len(text):
            place = _code_points(data, {p for start, _, end in found for p in (start, end)})
            found = [(place[start], i, place[end]) for start, i, end in found]
        return [(self.rules[i].kind, start, end) for start, i, end in found]


class _Vain:
    """States from which a rule has found nothing more, by place: the first one of a place in an array, others in a set."""

    def __init__(self, length: int):
        self.length, self.known, self.first, self.more = length, False, array("I"), set()

    def add(self, at: int, state: int) -> None:
        if not self.known:
            self.known, self.first = True, array("I", bytes(4 * (self.length // STEP + 1)))
        if not self.first[at // STEP]:
            self.first[at // STEP] = state + 1
        elif self.first[at // STEP] != state + 1:
            self.more.add((at, state))

    def holds(self, at: int, state: int) -> bool:
        return self.first[at // STEP] == state + 1 or (at, state) in self.more


def _code_points(data: bytes, places: set[int]) -> dict[int, int]:
    """The number of code points before each place, counted once along the bytes."""
    if not places:
        return {}
    ordered = sorted(places)
    leads = np.concatenate([(np.frombuffer(data, np.uint8) & 0xC0) != 0x80, [False]])
    counts = np.add.reduceat(leads, [0, *ordered], dtype=np.int64)[:-1] if ordered[0] else np.concatenate([[0], np.add.reduceat(leads, ordered, dtype=np.int64)[:-1]])
    return dict(zip(ordered, np.cumsum(counts).tolist(), strict=True))


def _width(head: str) -> int:
    least, most = sre.parse(head).getwidth()
    if least != most:
        raise ValueError(f"a head must have a fixed width: {head}")
    return least


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>> of all spans, by start and then in the rules' order; empty where none."""

    def run(texts: pa.Array) -> pa.Array:
        s = scanner(rules)
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s.spans(t.as_py() or "")] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(run, SPANS)(text)


def redact(text: str, spans: str, kinds: tuple[str, ...] = tuple(r.kind for r in RULES)) -> Column:
    """The text with each span replaced by [SECRET]; spans that overlap are replaced as one."""
    inside = ", ".join(f"'{k}'" for k in kinds)
    held = f"filter(`{spans}`, s -> s.kind IN ({inside}))"
    # The fold carries what is done so far and the end of the text that it has used up.
    fold = (
        f"aggregate({held}, struct('' AS done, 0 AS used), (a, s) -> CASE WHEN s.start < a.used "
        f"THEN struct(a.done AS done, greatest(a.used, s.end) AS used) "
        f"ELSE struct(concat(a.done, substring(`{text}`, a.used + 1, s.start - a.used), '[SECRET]') AS done, s.end AS used) END, "
        f"a -> concat(a.done, substring(`{text}`, a.used + 1)))"
    )
    return F.expr(f"CASE WHEN size({held}) = 0 THEN `{text}` ELSE {fold} END")
