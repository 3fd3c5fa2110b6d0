"""Quality rules as a short-circuit cascade of native Spark expressions.

Every rule is a boolean Column over the text's features. ``plan_cascade`` measures each rule on a bounded
sample (share of rows it rejects, seconds it takes beyond reading the text) and orders the rules by rejection per
second; ``cascade`` chains them in that order with CASE WHEN, so that a row which one rule rejects costs nothing
more. The order changes the cost only, never the verdict, which is the conjunction of all rules.

Defined results: a null text counts as a text without words; repeated rows are judged row by row; an empty table
gives an empty table; further columns pass through untouched, but for columns that have the name of an added one
(``prefix`` before n_words, ..., kept), which it replaces; helper columns take names that no column has.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: White space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rows of the sample on which rules are measured, the share of the rows it is drawn from, and its files at most.
SAMPLE_ROWS = 1000
SAMPLE_SHARE = 0.1
SAMPLE_FILES = 8
#: How often a rule is evaluated over the sample in one job, and how many such jobs are timed.
REPEATS, TIMES = 5, 3


@dataclass(frozen=True)
class Rule:
    """A named condition that good rows meet; it must be true or false, never null."""

    name: str
    passes: Column


def text_features(df: DataFrame, text: str = "text", prefix: str = "", words: str = "words") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long), named with ``prefix``.

    The helper column ``words`` stays, for rules on words.
    """
    p = prefix
    lines, windows, order = fresh([*df.columns, words], "_lines", "_windows", "_sorted")
    body = f"coalesce(`{text}`, '')"
    blank = "' \\t\\n\\u000b\\u000c\\r'"
    trimmed = df.withColumn(words, F.expr(
        f"CASE WHEN trim(BOTH {blank} FROM {body}) = '' THEN array() "
        f"ELSE split(trim(BOTH {blank} FROM {body}), '[ \\\\t-\\\\r]+') END"))
    w = f"`{words}`"
    counted = trimmed.withColumns({
        f"{p}n_words": F.expr(f"cast(size({w}) AS bigint)"),
        f"{p}word_chars": F.expr(f"cast(length(translate({body}, {blank}, '')) AS bigint)"),
        f"{p}n_symbols": F.expr(f"cast(length({body}) - length(translate({body}, '{SYMBOLS}', '')) AS bigint)"),
        lines: F.expr(f"filter(split({body}, '\\n'), x -> trim(BOTH {blank} FROM x) != '')"),
        windows: F.expr(
            f"CASE WHEN size({w}) < 3 THEN cast(array() AS array<bigint>) "
            f"ELSE transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])) END"),
    })
    # Windows that occur once only are the common case; only the others are sorted.
    ordered = counted.withColumn(order, F.expr(
        f"CASE WHEN size(array_distinct(`{windows}`)) = size(`{windows}`) "
        f"THEN cast(array() AS array<struct<h:bigint,i:int>>) "
        f"ELSE sort_array(transform(`{windows}`, (h, i) -> struct(h AS h, i AS i))) END"))
    s = f"`{order}`"
    same = " AND ".join(f"{w}[{s}[k].i + {j}] = {w}[{s}[k - 1].i + {j}]" for j in range(3))
    covered = ", ".join(f"{s}[k{back}].i + {j}" for back in ("", " - 1") for j in range(3))
    return ordered.withColumns({
        f"{p}n_lines": F.expr(f"cast(size(`{lines}`) AS bigint)"),
        f"{p}n_dup_lines": F.expr(f"cast(size(`{lines}`) - size(array_distinct(`{lines}`)) AS bigint)"),
        f"{p}n_repeat_words": F.expr(
            f"CASE WHEN size({s}) < 2 THEN 0L ELSE cast(size(array_distinct(flatten(transform("
            f"filter(sequence(1, size({s}) - 1), k -> {s}[k].h = {s}[k - 1].h AND {same}), "
            f"k -> array({covered}))))) AS bigint) END"),
    }).drop(lines, windows, order)


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows of three."""
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def default_rules(prefix: str = "", words: str = "words") -> list[Rule]:
    """Rules on what ``text_features`` adds: symbols, shouting, marks, repeated lines, word length and letters."""
    p = prefix
    c = lambda name: F.col(f"{p}{name}")
    share = lambda test: F.expr(f"cast(size(filter(`{words}`, x -> {test})) AS bigint)")
    return [
        Rule("symbols", 10 * c("n_symbols") <= c("n_words")),
        Rule("repeated_lines", 2 * c("n_dup_lines") <= c("n_lines")),
        Rule("word_length", (c("word_chars") >= 2 * c("n_words")) & (c("word_chars") <= 20 * c("n_words"))),
        Rule("shouting", 2 * share("length(x) > 1 AND x = upper(x) AND x != lower(x)") <= c("n_words")),
        Rule("marks", 4 * share("contains(x, '!!') OR contains(x, '??')") <= c("n_words")),
        Rule("letters", 2 * share("x rlike '\\\\p{L}'") >= c("n_words")),
        Rule("varied", 20 * F.expr(f"cast(size(array_distinct(`{words}`)) AS bigint)") >= F.least(c("n_words"), F.lit(400))),
    ]


def draw(df: DataFrame, rows: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE, files: int = SAMPLE_FILES) -> DataFrame:
    """At most ``rows`` rows, read bit by bit until there are enough, from files spread over the table where it has many."""
    paths = sorted(df.inputFiles())
    if len(paths) > files:
        try:
            df = df.filter(F.col("_metadata.file_path").isin(paths[:: -(-len(paths) // files)]))
        except AnalysisException:
            pass  # no plain scan: its first partitions have to do
    return df.sample(fraction=share, seed=17).limit(rows)


def plan_cascade(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules ordered by rejected share per second on a small sample with its features.

    The features are computed once, as the output needs them anyway, and kept. Each rule is then evaluated over them by
    itself, ``REPEATS`` times in one job and ``TIMES`` times over; the median time beyond that of no rule is its cost.
    Rules that reject nothing there come last, cheapest first.
    """
    sample = sample.persist()
    try:
        verdicts = sample.select(*[r.passes.alias(f"r{i}") for i, r in enumerate(rules)]).collect()
        if not verdicts:
            return list(rules)
        many = sample.crossJoin(sample.sparkSession.range(REPEATS).select(F.col("id").alias(fresh(sample.columns, "_repeat")[0])))

        def took(column: Column) -> float:
            times = []
            for _ in range(TIMES):
                began = time.monotonic()
                many.agg(F.count_if(column)).collect()
                times.append(time.monotonic() - began)
            return median(times)

        idle = took(F.lit(True))
        ranked = []
        for i, rule in enumerate(rules):
            rejected = sum(not v[i] for v in verdicts) / len(verdicts)
            cost = max(took(rule.passes) - idle, 1e-4)
            ranked.append((-rejected / cost, cost, i))
        return [rules[i] for *_, i in sorted(ranked)]
    finally:
        sample.unpersist()


def cascade(ordered: list[Rule]) -> Column:
    """Name of the first rule in this order that rejects the row, null where all pass; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(~rule.passes, F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_rules(df: DataFrame, text: str = "text", rules: Callable[[str, str], list[Rule]] = default_rules, prefix: str = "") -> DataFrame:
    """Adds the features, base_failed, rejected_by (a rule's name or null) and kept; all rows stay.

    ``rules`` makes the rules from the prefix and the name of the helper column of words. Which of several failing
    rules rejected_by names depends on the measured order; kept doesn't.
    """
    p = prefix
    (words,) = fresh(df.columns, "_words")
    featured = text_features(df, text, p, words)
    ordered = plan_cascade(text_features(draw(df), text, p, words), rules(p, words))
    judged = featured.withColumn(f"{p}base_failed", base_failed(p))
    verdict = F.when(F.col(f"{p}base_failed"), F.lit("base")).otherwise(cascade(ordered))
    return judged.withColumn(f"{p}rejected_by", verdict).withColumn(f"{p}kept", F.col(f"{p}rejected_by").isNull()).drop(words)
