"""Articles, sections and letters of contracts as plain marked-up text.

Headings of articles also stand in a table of contents and where one article speaks of another. The body's headings are the
longest run of them whose numbers increase; of runs of equal length the one that begins last, and then each of its headings as
late as it can stand. A run is sought among a text's heading numbers; all else is work on lines, by windows along a text.

Null texts have no articles; a text without headings has none. Letters of understanding begin behind the last article.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"(?i)^#{1,2}\s*ARTICLE\s+(\d+)(.*)$"
TITLE_LINE = r"^#{1,2}\s+([A-Z][A-Z\s\-,/]+)$"
LETTERS = r"(?i)^#{0,2}\s*(?:.*\s)?LETTERS OF UNDERSTANDING\b"
LETTER = r"^(\d+)\.\s+([A-Z][\w\s.-]*)$"
SECTION = r"(?i)^Section\s+(\d+)\.?\s*"
SUBSECTION = r"^\(([a-z])\)\s+"
#: Sizes in characters: sections that are parted at their subsections, pieces and preambles that are kept, letters.
LONG_SECTION, LEAST_PIECE, LEAST_PREAMBLE, LEAST_LETTER, MOST_LETTER = 800, 50, 100, 30, 2000


def last_run(numbers: list[int]) -> list[int]:
    """The places of the longest strictly increasing run; of several the latest one, heading by heading."""
    n = len(numbers)
    # From the end: how long a run can begin at a place. ends holds the negated numbers that runs begin with, by length.
    ends: list[int] = []
    length = [0] * n
    for i in range(n - 1, -1, -1):
        at = bisect_left(ends, -numbers[i])
        ends[at : at + 1] = [-numbers[i]]
        length[i] = at + 1
    out: list[int] = []
    want = len(ends)
    before = None
    by_length: dict[int, list[int]] = {}
    for i, m in enumerate(length):
        by_length.setdefault(m, []).append(i)
    for m in range(want, 0, -1):
        i = next(i for i in reversed(by_length[m]) if before is None or (i > before and numbers[i] > numbers[before]))
        out.append(i)
        before = i
    return out


def _runs(numbers: Column) -> Column:
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([last_run(r) for r in rows.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(numbers)


def article_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line, part, article, title): the lines of each text by what they belong to.

    ``part`` counts the articles' headings so far, 0 ahead of the first one; lines from the letters' heading on have -1.
    """
    along = Window.partitionBy(key).orderBy("at")
    lines = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    rest = F.trim(F.regexp_extract("line", HEADING, 2))
    below = F.trim(F.regexp_extract(F.coalesce(F.lead("line").over(along), F.lit("")), TITLE_LINE, 1))
    lines = lines.withColumn("number", F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 1).cast("bigint"))).withColumn("_title", F.when((rest != "") & ~rest.startswith("#"), rest).otherwise(below))
    heads = lines.filter("number IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "number", "_title"))).alias("_h"))
    chosen = heads.select(key, F.explode(F.transform(_runs(F.col("_h.number")), lambda k: F.col("_h")[k])).alias("_c"))
    chosen = chosen.select(key, F.col("_c.at").alias("at"), F.col("_c.number").alias("article"), F.col("_c._title").alias("title"))
    told = lines.drop("number", "_title").join(chosen, [key, "at"], "left")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("part", F.count("article").over(so_far).cast("int"))
    last = F.max("part").over(Window.partitionBy(key))
    letters = F.max((F.col("line").rlike(LETTERS) & F.col("article").isNull() & (F.col("part") == last)).cast("int")).over(so_far)
    told = told.withColumn("part", F.when((letters == 1) & (last > 0), -1).otherwise(F.col("part")))
    carried = Window.partitionBy(key, "part").orderBy("at")
    whole = carried.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Without a title beside or below the heading, the first of its three lines in capitals is the title.
    bare = F.trim(F.regexp_replace("line", r"(?i)^#{1,2}\s*ARTICLE\s+\d+\s*", ""))
    capitals = (F.row_number().over(carried) <= 3) & (F.length(bare) > 3) & (bare == F.upper(bare)) & (bare != F.lower(bare))
    told = told.withColumn("_bare", F.when(capitals, bare)).withColumn("article", F.first("article").over(carried))
    title = F.coalesce(F.nullif(F.first("title").over(carried), F.lit("")), F.first("_bare", True).over(whole), F.concat(F.lit("ARTICLE "), F.col("article").cast("string")))
    return told.withColumn("title", title).drop("_bare")


def _joined(order: str = "at", line: str = "line") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def articles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, article, title, content): each article of the body from its heading to the next one."""
    found = article_lines(df, key, text).filter("part > 0").groupBy(key, "part", "article").agg(F.first("title").alias("title"), _joined().alias("content"))
    return found.select(key, "article", "title", "content")


def clean(text: Column) -> Column:
    """Without page numbers at line ends, rules and tags of tables and changes; runs of blanks and empty lines as one."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?md)\d+\s*$", ""), r"(?md)^---+\s*$", "")
    for pattern, to in ((r"</?(?:table|thead|tbody)[^>]*>", ""), (r"</?tr[^>]*>", "\n"), (r"</?t[hd][^>]*>", " | "), (r"</?(?:ins|del)>", ""), (r"\n{3,}", "\n\n"), (r" {2,}", " ")):
        out = F.regexp_replace(out, pattern, to)
    return _strip(out)


def pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, article, title, section, subsection, content): the body in chunks, not cleaned yet.

    An article is parted at its sections, and a section of more than LONG_SECTION characters at its subsections; an article without
    sections is one chunk; what stands ahead of the first section is one, if it says enough.
    """
    lines = article_lines(df, key, text).filter("part > 0")
    starts = F.when(F.col("line").rlike(SECTION), F.regexp_extract("line", SECTION, 1).cast("bigint"))
    along = Window.partitionBy(key, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_s", starts).withColumn("no", F.count("_s").over(along)).withColumn("_line", F.when(F.col("_s").isNotNull(), F.regexp_replace("line", SECTION, "")).otherwise(F.col("line")))
    whole = lines.groupBy(key, "part", "article", "no").agg(F.first("title").alias("title"), F.first("_s", True).alias("section"), F.min("at").alias("at"), _joined("at", "_line").alias("content"))
    count = F.max("no").over(Window.partitionBy(key, "part"))
    whole = whole.withColumn("_n", count).withColumn("content", F.when((F.col("_n") == 0), F.col("content")).otherwise(_strip(F.col("content"))))
    without = F.length(_strip(F.regexp_replace("content", r"(?md)^#{1,2}.*$", "")))
    keep = F.when(F.col("no") > 0, F.col("content") != "").otherwise((F.col("_n") == 0) | ((F.length("content") > LEAST_PREAMBLE) & (without > LEAST_PIECE)))
    whole = whole.filter(keep)
    parts = F.filter(F.transform(F.split("content", r"\n(?=\([a-z]\)\s)"), lambda x, i: F.struct(i.alias("i"), F.when(i > 0, F.nullif(F.regexp_extract(x, SUBSECTION, 1), F.lit(""))).alias("sub"), _strip(F.when(i > 0, F.regexp_replace(x, SUBSECTION, "")).otherwise(x)).alias("body"))),
                     lambda p: (p["body"] != "") & ((F.length(p["body"]) > LEAST_PIECE) | (p["i"] == F.size(F.split("content", r"\n(?=\([a-z]\)\s)")) - 1)))
    split = (F.col("no") > 0) & (F.length("content") > LONG_SECTION) & F.col("content").rlike(r"\n\([a-z]\)\s")
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("sub"), F.col("content").alias("body")))
    cut = whole.withColumn("_p", F.explode(F.when(split, parts).otherwise(one)))
    return cut.select(key, F.struct("part", "no", F.col("_p.i").alias("i")).alias("place"), "article", "title", "section", F.col("_p.sub").alias("subsection"), F.col("_p.body").alias("content"))


def letters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, letter, title, content): numbered letters of understanding behind the articles, cleaned and cut to MOST_LETTER characters."""
    lines = article_lines(df, key, text).filter("part = -1")
    along = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_n", F.when(F.col("line").rlike(LETTER), F.regexp_extract("line", LETTER, 1))).withColumn("no", F.count("_n").over(along)).filter("no > 0")
    title = F.substring(F.trim(F.regexp_extract(F.first(F.when(F.col("_n").isNotNull(), F.col("line")), True), LETTER, 2)), 1, 50)
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n").isNull(), F.struct("at", "line")))), lambda x: x["line"])
    g = lines.groupBy(key, "no").agg(F.min("at").alias("at"), F.first("_n", True).alias("letter"), title.alias("title"), clean(_strip(F.array_join(body, "\n"))).alias("content"))
    return g.filter(F.length("content") >= LEAST_LETTER).select(key, "at", "letter", "title", F.substring("content", 1, MOST_LETTER).alias("content"))


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_id, doc_type, article, section, subsection, title, citation, content) of body and letters; repeated ids get a number."""
    body = pieces(df, key, text)
    text_of = lambda c: c.cast("string")
    base = F.concat(F.lit("art"), text_of(F.col("article")), F.coalesce(F.concat(F.lit("_sec"), text_of(F.col("section"))), F.lit("")), F.coalesce(F.concat(F.lit("_"), "subsection"), F.lit("")))
    cited = F.concat(F.lit("Article "), text_of(F.col("article")), F.coalesce(F.concat(F.lit(", Section "), text_of(F.col("section"))), F.lit("")), F.coalesce(F.concat(F.lit("("), "subsection", F.lit(")")), F.lit("")))
    one = body.select(key, "place", base.alias("_id"), F.lit("cba").alias("doc_type"), "article", "section", "subsection", "title", cited.alias("citation"), clean(F.col("content")).alias("content"))
    label = F.concat(F.lit("Letter of Understanding "), F.col("letter"))
    none = F.lit(None)
    two = letters(df, key, text).select(
        key, F.struct(F.lit(1 << 30).alias("part"), F.lit(0).cast("bigint").alias("no"), F.col("at").alias("i")).alias("place"), F.concat(F.lit("lou_"), "letter").alias("_id"), F.lit("lou").alias("doc_type"),
        none.cast("bigint").alias("article"), none.cast("bigint").alias("section"), none.cast("string").alias("subsection"), F.concat(label, F.lit(": "), "title").alias("title"), label.alias("citation"), "content",
    )
    both = one.unionByName(two)
    again = F.row_number().over(Window.partitionBy(key, "_id").orderBy("place")) - 1
    return both.withColumn("_k", again).withColumn("chunk_id", F.when(F.col("_k") == 0, F.col("_id")).otherwise(F.concat_ws("_", "_id", "_k"))).select(key, "chunk_id", "doc_type", "article", "section", "subsection", "title", "citation", "content")
