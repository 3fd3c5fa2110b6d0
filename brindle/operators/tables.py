"""Tables of pages beside a registry of tables: which is which, what a table is about, and what it belongs to."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A late article, from which on tables of wages are an appendix's.
LATE_ARTICLE = 50
MATCHES = "contract {0}, place bigint, table_id string, how string"

# Words of a table that tell its topic.
TOPIC_WORDS = {
    "wages": ("wage", "rate", "hourly", "progression", "journeyman", "classification"),
    "vacation": ("vacation", "holiday", "paid time"),
    "health_benefits": ("benefit", "medical", "dental", "vision", "insurance"),
}


def match_tables(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """(contract, place, table_id, how) of each table of the pages: 'hash', 'heading', 'only', 'synthesized' or 'unparseable'.

    ``pages``: contract, place (a bigint that orders a contract's tables), hash (null for a table without rows), article,
    heading. ``registry``: contract, place, table_id, hash, article, path (array of headings).

    A table with the registry's hash is that table, of equal ones the last. Else it is the first table of its article that is
    still free and whose path holds its heading or lies within it, else the only free one of the article. Else one is made, which
    later tables of its hash find. What is matched, also by hash, is free no more; a table without an article is found by hash
    only. The fold goes along a contract's tables by their hashes and headings: a contract is one document's size.
    """
    light = registry.select(F.col("contract").alias("of"), F.col("place").alias("at"), F.col("table_id").alias("id"), F.col("hash").alias("sum"), F.coalesce("article", F.lit(0)).alias("number"), F.transform("path", lambda h: F.lower(h)).alias("path"))
    asked = pages.select("contract", "place", "hash", "article", F.lower(F.coalesce("heading", F.lit(""))).alias("heading"))
    kind = pages.schema["contract"].dataType.simpleString()
    return asked.groupBy("contract").cogroup(light.groupBy("of")).applyInPandas(_match, MATCHES.format(kind))


def _match(key: tuple, pages: pd.DataFrame, registry: pd.DataFrame) -> pd.DataFrame:
    by_hash: dict[str, str] = {}
    by_article: dict[int, list[tuple[str, list[str]]]] = defaultdict(list)
    for r in registry.sort_values(["at", "id"]).itertuples():
        if r.sum is not None:
            by_hash[r.sum] = r.id
        by_article[int(r.number)].append((r.id, list(r.path if r.path is not None else [])))
    used: set[str] = set()
    out = []
    for p in pages.sort_values(["place", "hash"]).itertuples():
        article = None if pd.isna(p.article) else int(p.article)
        found, how = by_hash.get(p.hash), "hash"
        if found is None and article is not None:
            free = [(t, path) for t, path in by_article[article] if t not in used]
            found, how = next((t for t, path in free if any(h in p.heading or p.heading in h for h in path)), None), "heading"
            if found is None and len(free) == 1:
                found, how = free[0][0], "only"
        if found is None and p.hash is not None:
            found, how = f"tbl_fallback_art{article or 0}_{p.hash[:8]}", "synthesized"
            by_hash[p.hash] = found
        if found is None:
            how = "unparseable"
        else:
            used.add(found)
        out.append((key[0], p.place, found, how))
    return pd.DataFrame(out, columns=["contract", "place", "table_id", "how"])


def _all_text(heading: Column, markdown: Column, csv: Column) -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce(heading, F.lit("")), F.coalesce(markdown, F.lit("")), F.coalesce(csv, F.lit(""))))


def is_contents(heading: Column, markdown: Column, csv: Column) -> Column:
    return _all_text(heading, markdown, csv).contains("table of contents")


def doc_type(heading: Column, markdown: Column, csv: Column, article: Column) -> Column:
    """'appendix' by its heading, or for a table of wages of a late article; else 'cba'."""
    raw = _all_text(heading, markdown, csv)
    priced = raw.contains("classification") & raw.contains("effective") & (F.regexp_count(raw, F.lit("[$]")) >= 3)
    late = (priced | raw.contains("rates of pay")) & F.coalesce(article >= LATE_ARTICLE, F.lit(False))
    return F.when(F.lower(F.coalesce(heading, F.lit(""))).contains("appendix") | late, "appendix").otherwise("cba")


def topics(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(topic)) for topic, words in TOPIC_WORDS.items()]))


def appendix_label(heading: Column, markdown: Column, csv: Column) -> Column:
    """How a table of an appendix is cited: by the letter of its heading, as Appendix A where its text says so, as its wage table, or plainly."""
    raw = _all_text(heading, markdown, csv)
    letter = F.regexp_extract(F.coalesce(heading, F.lit("")), '(?i)appendix\\s*"?([a-z0-9]+)"?', 1)
    wages = (raw.contains("classification") & raw.contains("effective") & (F.regexp_count(raw, F.lit("[$]")) >= 2)) | raw.rlike("rate of pay|hourly rate|wage progression")
    return (
        F.when(letter != "", F.concat(F.lit("Appendix "), F.upper(letter))).when(raw.rlike('appendix\\s*"?a"?'), "Appendix A")
        .when(wages, "Appendix A Wage Table").otherwise("Appendix")
    )
