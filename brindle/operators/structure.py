"""Structure of texts that come as numbered lines: headings carried forward, sections, chunks with ids and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARTICLE = r"(?i)^(?:#+\s*)?article\s+([0-9]+[a-z]?)\s*[:\-.]?\s*(.*)$"
SECTION = r"(?i)^(?:#+\s*)?(?:section|sec\.?)\s+([0-9]+(?:\.[0-9a-z]+)?)\s*[:\-.]?\s*(.*)$"
LETTERED = r"^\(?([a-z])[.)]\s+(.*)$"


def _found(line: Column, pattern: str, group: int) -> Column:
    """The group where the pattern matches, null where it doesn't."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def with_headings(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """Adds article, article_title, section and section_title: those of the last headings at or before each line.

    A new article ends the section before it. Windows over a document's lines; documents are the unit of work.
    """
    by_place = Window.partitionBy(doc).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({
        "_a": F.when(F.col(line).rlike(ARTICLE), F.struct(_found(F.col(line), ARTICLE, 1).alias("n"), _found(F.col(line), ARTICLE, 2).alias("t"))),
        "_s": F.when(F.col(line).rlike(SECTION), F.struct(_found(F.col(line), SECTION, 1).alias("n"), _found(F.col(line), SECTION, 2).alias("t"))),
    })
    carried = marked.withColumn("_in", F.last("_a", True).over(by_place)).withColumn("_part", F.count("_a").over(by_place))
    within = Window.partitionBy(doc, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    done = carried.withColumn("_sec", F.last("_s", True).over(within))
    return done.select(
        *lines.columns, F.col("_in.n").alias("article"), F.col("_in.t").alias("article_title"), F.col("_sec.n").alias("section"), F.col("_sec.t").alias("section_title"),
        F.col("_a").isNotNull().alias("is_article"), F.col("_s").isNotNull().alias("is_section"),
    )


def with_offsets(lines: DataFrame, doc: str, at: str, line: str, gap: int) -> DataFrame:
    """Adds start and end: the running offsets of a document's lines, each ``gap`` characters longer than its text."""
    w = Window.partitionBy(doc).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(line) + gap).over(w)
    return lines.withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.length(line) - gap)


def page_at(offsets: DataFrame, pages: DataFrame, doc: str, offset: str, end: str, page: str) -> DataFrame:
    """The first page that ends at or behind each offset, or the last page; without a range join: both sides in one order."""
    both = offsets.select(doc, F.col(offset).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(pages.schema[page].dataType).alias("_page"), F.struct(*offsets.columns).alias("_row")).unionByName(
        pages.select(doc, F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.col(page).alias("_page"), F.lit(None).cast(offsets.select(F.struct(*offsets.columns).alias("r")).schema["r"].dataType).alias("_row"))
    )
    # From the end backwards, so that a frame only grows: Spark computes one that shrinks anew for each row.
    w = Window.partitionBy(doc).orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_page"))
    here = F.last("_page", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    final = F.first("_page", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("_here", F.coalesce(here, final)).filter("_kind = 0").select("_row.*", F.col("_here").alias(page))


def section_parts(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """Adds part: the letter of the subsection that a line belongs to, where its section has two or more of them."""
    w = Window.partitionBy(doc, "article", "section").orderBy(at)
    letter = _found(F.col(line), LETTERED, 1)
    marked = lines.withColumn("_l", letter).withColumn("_n", F.count("_l").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    part = F.when((F.col("_n") >= 2) & F.col("section").isNotNull(), F.last("_l", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("part", part).withColumn("_lettered", (F.col("_n") >= 2) & F.col("section").isNotNull()).drop("_l", "_n")


def chunks(lines: DataFrame, doc: str, at: str, line: str) -> DataFrame:
    """One row per chunk: lettered subsections where a section has two or more, else the section, else the article.

    Lines ahead of a section's first letter, and ahead of an article's first section, belong to no chunk.
    """
    told = section_parts(with_headings(lines, doc, at, line), doc, at, line).filter("article IS NOT NULL")
    bare = Window.partitionBy(doc, "article")
    told = told.withColumn("_has", F.max(F.col("section").isNotNull()).over(bare))
    kept = told.filter("(NOT _has OR section IS NOT NULL) AND (NOT _lettered OR part IS NOT NULL)")
    made = kept.groupBy(doc, "article", "section", "part").agg(
        F.min(at).alias("first"), F.min_by("article_title", at).alias("article_title"), F.min_by("section_title", at).alias("section_title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, line))), lambda r: r[line]), "\n").alias("content"),
    )
    return made


def chunk_id(article: Column, section: Column, part: Column) -> Column:
    return F.concat(F.lit("art"), article, F.when(section.isNotNull(), F.concat(F.lit("_sec"), section)).otherwise(""), F.when(part.isNotNull(), F.concat(F.lit("_sub_"), part)).otherwise(""))


def citation(article: Column, section: Column, part: Column) -> Column:
    return F.concat(F.lit("Article "), article, F.when(section.isNotNull(), F.concat(F.lit(", Section "), section)).otherwise(""), F.when(part.isNotNull(), F.concat(F.lit(", Subsection "), part)).otherwise(""))


def parent_context(article: Column, article_title: Column, section: Column, section_title: Column, part: Column) -> Column:
    named = F.when(section.isNotNull(), F.concat(F.lit("Section "), section, F.when(section_title != "", F.concat(F.lit(" ("), section_title, F.lit(")"))).otherwise("")))
    return F.concat_ws(" > ", F.concat(F.lit("Article "), article, F.lit(" ("), article_title, F.lit(")")), named, F.when(part.isNotNull(), F.concat(F.lit("Subsection "), part)))


def first_sentence(text: Column, limit: int = 180) -> Column:
    """Up to the first mark of an end with white space behind it; a longer one is cut at a word and gets dots."""
    norm = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    sentence = F.split(norm, r"(?<=[.!?])\s+", 2)[0]
    cut = F.rtrim(F.substring(sentence, 1, limit))
    clipped = F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(sentence) <= limit, sentence).otherwise(F.concat(clipped, F.lit("...")))


def short_label(title: Column, most: int = 80) -> Column:
    """A title of 80 characters at most: cut at a sentence, else at a word, if 30 characters are left."""
    text = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    window = F.substring(text, 1, most + 1)
    last = lambda mark: F.length(window) - F.locate(mark[::-1], F.reverse(window)) - len(mark) + 1  # noqa: E731  place from 0; -1 where absent
    at = lambda mark: F.when(F.locate(mark[::-1], F.reverse(window)) > 0, last(mark)).otherwise(-1)
    cut = lambda mark, drop: F.concat(F.regexp_replace(F.substring(window, F.lit(1), at(mark)), drop, ""), F.lit("…"))
    return (
        F.when(F.length(text) <= most, text).when(at(". ") >= 30, cut(". ", r"[ .;]+$")).when(at("; ") >= 30, cut("; ", r"[ .;]+$"))
        .when(at(" ") >= 30, cut(" ", r"[ ,;:]+$")).otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…")))
    )


def related_sections(hits: DataFrame, sections: DataFrame, doc: str, k: int = 2) -> DataFrame:
    """Up to ``k`` further sections of each article that was hit: those referred to, the adjacent, the nearest.

    ``hits``: doc, article, section, refs (array of sections named in the text); ``sections``: doc, article, section.
    """
    base = hits.groupBy(doc, "article").agg(F.collect_set("section").alias("_base"), F.array_distinct(F.flatten(F.collect_list("refs"))).alias("_refs"))
    near = F.array_min(F.transform("_base", lambda b: F.abs(F.col("section") - b)))
    told = sections.join(base, [doc, "article"]).filter(~F.array_contains("_base", F.col("section")))
    named = F.array_contains("_refs", F.col("section"))
    rank = F.struct(F.when(named, 0).when(near <= 1, 1).otherwise(2).alias("p"), F.when(named, 0).otherwise(near).alias("d"))
    w = Window.partitionBy(doc, "article").orderBy("_rank", "section")
    return told.withColumn("_rank", rank).withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= k).select(doc, "article", "section", F.col("_rank.p").alias("kind"), "place")


#: Characters of a section from which on it is cut, and of the pieces that paragraphs are packed into.
LONG, PIECE = 2000, 800
NUMBERED = r"\n(?=\(?\d{1,3}[.)]\s)"


def segments(content: Column) -> Column:
    """array<struct<segment, citation, text>>: one for a text of 2,000 characters at most; else its numbered parts, where it has three or more, else packed paragraphs."""
    from ..functions.text import pack_paragraphs

    numbered = F.split(content, NUMBERED)
    pieces = F.when(F.size(numbered) >= 4, numbered).otherwise(pack_paragraphs(content, PIECE, 0))
    named = F.transform(pieces, lambda t, i: F.struct(F.concat(F.lit("seg_"), F.lpad((i + 1).cast("string"), 3, "0")).alias("segment"), F.concat(F.lit("Part "), (i + 1).cast("string")).alias("citation"), t.alias("text")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("segment"), F.lit(None).cast("string").alias("citation"), content.alias("text")))
    return F.when(F.length(content) <= LONG, whole).otherwise(named)
