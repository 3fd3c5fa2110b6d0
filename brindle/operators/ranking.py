"""Ranking of retrieved rows: fuzzy and alias bonuses, tenant scores, title boosts, expansions of questions, evidence gates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import runs
from .sequences import similar_pairs


def fuzzy_bonus(df: DataFrame, key: str, text: str, terms: list[str], found: float = 0.2, like: float = 0.16, least: float = 0.84) -> DataFrame:
    """(key, bonus): for each term ``found`` where the text holds it, else ``like`` times its best similarity to a word of 3 letters or more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = df.select(key, *[low.contains(t).alias(f"_h{i}") for i, t in enumerate(terms)], F.array_distinct(F.filter(runs(F.coalesce(text, F.lit("")), 1), lambda w: F.length(w) >= 3)).alias("_w"))
    words = held.select(key, F.explode("_w").alias("word"))
    asked = df.sparkSession.createDataFrame([(i, t.lower().strip()) for i, t in enumerate(terms)], "term_no int, term string")
    pairs = similar_pairs(asked, words, least).join(F.broadcast(asked), "term")  # a row per term of the question
    best = words.join(pairs, "word").groupBy(key).pivot("term_no", list(range(len(terms)))).agg(F.max("score"))
    joined = held.drop("_w").join(best, key, "left")
    each = [F.when(F.col(f"_h{i}"), found).otherwise(like * F.coalesce(F.col(f"`{i}`"), F.lit(0.0))) for i in range(len(terms))]
    return joined.select(key, reduce(lambda a, b: a + b, each).alias("bonus"))


def alias_bonus(question: str, aliases: Column) -> Column:
    """0.08 for each distinct alias of several words, six characters or more, that the question holds; 0.1 at most."""
    phrases = F.array_distinct(F.transform(aliases, lambda a: F.lower(F.trim(a))))
    hits = F.size(F.filter(phrases, lambda p: (F.length(p) >= 6) & p.contains(" ") & F.lit(question.lower()).contains(p)))
    return F.least(F.lit(0.1), 0.08 * hits)


def tenant_score(similarity: Column, bonus: Column, sensitive: Column, injected: Column, alias: Column) -> Column:
    """The similarity is the ranking: bonuses are capped at 0.05, penalties aren't, and an alias counts where nothing is penalized."""
    total = bonus - F.when(sensitive, 0.22).otherwise(0.0) - F.when(injected, 1.5).otherwise(0.0)
    return similarity + F.when(total > 0, F.least(total, F.lit(0.05))).otherwise(total) + F.when(total > -0.1, alias).otherwise(0.0)


def title_matches(title: Column, wanted: list[str]) -> Column:
    """Whether a title matches one of the wanted ones: all its words of 3 letters or more, the title's first two, or either within the other."""
    low = F.lower(F.coalesce(title, F.lit("")))
    own = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2)
    tests = []
    for raw in wanted:
        h = raw.lower().strip()
        words = [w for w in h.split() if len(w) > 2]
        if words:
            tests.append(reduce(lambda a, b: a & b, [low.contains(w) for w in words]))
        tests += [(F.size(own) >= 2) & _all_within(F.slice(own, 1, 2), h), low.contains(h) | F.lit(h).contains(low)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all_within(words: Column, text: str) -> Column:
    return F.forall(words, lambda w: F.lit(text).contains(w))


def fallback_rows(df: DataFrame, key: str, citation: str, title: str, text: str, article: str, section: str, terms: list[str], signals: list[str], preferred: list[int], locator: bool, k: int = 4, least: int = 2) -> DataFrame:
    """The first ``k`` rows with an article that hold enough of the question's terms; titles, preferred articles and locator questions weigh."""
    blob = F.lower(F.concat_ws(" ", citation, title, text))
    count = lambda of, words: reduce(lambda a, b: a + b, [of.contains(w).cast("int") for w in words], F.lit(0))
    hits, titled, inside = count(blob, terms), count(F.lower(title), signals), F.col(article).isin(*preferred)
    told = df.filter(F.col(citation).rlike(r"(?i)article\s+\d+")).withColumn("_hits", hits).withColumn("_titled", titled)
    keep = (F.col("_hits") >= least) | ((F.lit(locator) & (F.col("_titled") > 0) | inside) & (F.col("_hits") >= 1))
    score = F.col("_hits") + 0.75 * F.col("_titled") + F.when(F.lit(locator) & (F.col("_titled") > 0), 0.5).otherwise(0.0) + F.when(inside, 0.85).otherwise(0.0)
    return told.filter(keep).select(key, section, score.alias("score")).orderBy(F.desc("score"), section, key).limit(k)


def expand_synonyms(question: Column, concepts: dict[str, list[str]], groups: list[list[str]], skip: tuple[str, ...], most: int = 5) -> Column:
    """The question and up to ``most`` further terms in brackets: of its phrases, of each word's group, of its phrases of several words.

    The dictionaries are small and known when the query is built; words are looked up in a literal map.
    """
    low = F.lower(question)
    texts = lambda items: F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    found = [F.when(low.contains(p), texts(e)).otherwise(none) for p, e in concepts.items()]
    of_word: dict[str, list[str]] = {}
    for group in groups:
        for word in group:
            of_word.setdefault(word.lower(), [t for t in group if t.lower() != word.lower()][:3])
    table = F.create_map(*[x for w, t in of_word.items() for x in (F.lit(w), texts(t))])
    words = F.filter(F.regexp_extract_all(low, F.lit(r"\b(\w+)\b"), F.lit(1)), lambda w: (F.length(w) >= 3) & ~w.isin(*skip))
    found.append(F.flatten(F.transform(words, lambda w: F.coalesce(table[w], none))))
    for group in groups:
        found += [F.when(low.contains(t.lower()), texts([x for x in group if x.lower() != t.lower()][:3])).otherwise(none) for t in group if " " in t]
    terms = F.filter(F.array_distinct(F.concat(*found)), lambda t: ~low.contains(F.lower(t)))
    return F.when(F.size(terms) > 0, F.concat(question, F.lit(" ("), F.array_join(F.slice(terms, 1, most), " "), F.lit(")"))).otherwise(question)


def expand_slang(question: Column, slang: dict[str, str], detectors: list[tuple[str, str, str]] = ()) -> Column:
    """struct<text, applied>: the question with the contract's words for its slang behind it, and what was added for what.

    Slang is tried longest first, of equal lengths in its own order, then come the detectors (pattern, words, label). Words that stand
    there already are left out. The rules that a question meets are found first; the words are added by a fold over them.
    """
    low = F.lower(question)
    rules = [(rf"\b{re.escape(s)}\b", t, s) for s, t in sorted(slang.items(), key=lambda x: len(x[0]), reverse=True)] + list(detectors)
    met = [F.when(low.rlike(p), F.struct(F.lit(t).alias("words"), F.lit(f"{label} -> {t}").alias("told"))) for p, t, label in rules]
    hits = F.array_compact(F.array(*met)) if met else F.array().cast("array<struct<words:string,told:string>>")
    start = F.struct(question.alias("text"), F.array().cast("array<string>").alias("applied"))

    def add(state: Column, hit: Column) -> Column:
        more = F.struct(F.concat(state["text"], F.lit(" ("), hit["words"], F.lit(")")).alias("text"), F.concat(state["applied"], F.array(hit["told"])).alias("applied"))
        return F.when(F.lower(state["text"]).contains(hit["words"]), state).otherwise(more)

    return F.aggregate(hits, start, add)
