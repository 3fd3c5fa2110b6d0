"""Rows of wage tables: their type by ordered rules, and the dates and classes that hold for the rows behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Steps, words of class labels, words that no class label holds.
STEP = r"(?i)^(start|after\s+\d+\s+(?:hours?|months?)|first\s+\d+\s+hours?\s+worked|next\s+\d+\s+hours?\s+worked|thereafter)\b"
CLASS_HINTS = (
    "classification", "clerk", "manager", "cutter", "wrapper", "deli", "meat", "baker", "lead", "shopper", "assistant", "head", "starbucks", "courtesy", "cashier", "chef", "trainee", "apprentice", "seafood",
)
NO_CLASS = ("effective", "current", "year", "hours payable")
DATE = r"\d{1,2}/\d{1,2}/\d{2,4}"


def clean(cell: Column) -> Column:
    """Text of a cell without tags and entities, with single blanks."""
    text = F.replace(F.replace(F.regexp_replace(F.coalesce(cell, F.lit("")), "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def rate(cell: Column) -> Column:
    """The amount of a cell; null for shares, dashes and dates."""
    text = clean(cell)
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"^\$?\s*(\d+(?:\.\d+)?)$", 1)
    return F.when((number != "") & ~text.contains("%"), number.cast("double"))


def is_class_label(label: Column) -> Column:
    low, words = F.lower(label), F.size(F.split(label, " "))
    letters = F.length(F.regexp_replace(label, r"[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(label, r"[^A-Z]", ""))
    has = lambda parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    compact = ~label.rlike(r"\d") & ~has(NO_CLASS) & (letters > 0) & (words <= 8) & ((capitals >= 0.7 * letters) | label.rlike("[/&-]"))
    return (label != "") & ~label.rlike(STEP) & (has(CLASS_HINTS) | compact)


def row_type(cells: Column, expected: int, active: Column) -> Column:
    """The type of a row (array of cells), by the first rule that fits: separator, header, dates, step, class, rates, unclear, none.

    ``active``: whether a class holds for the row.
    """
    label = clean(F.get(cells, F.lit(0)))
    rest = F.transform(F.slice(cells, 2, F.size(cells)), clean)
    whole = F.lower(F.array_join(F.transform(cells, clean), " "))
    rates = F.size(F.filter(rest, lambda c: rate(c).isNotNull()))
    dates = F.size(F.filter(F.transform(cells, clean), lambda c: c.rlike(DATE)))
    dated = (dates >= 2) & (whole.contains("effective") | ((F.size(F.filter(rest, lambda c: c.rlike(DATE))) >= 2) & ~is_class_label(label)))
    blank = label.isin("", "-", "--", "_") & F.forall(rest, lambda c: c.isin("", "-", "--", "_"))
    many = max(2, expected - 1)
    return (
        F.when(blank, "separator").when(F.lower(label).contains("classification") & whole.contains("effective"), "header").when(dated, "effective_date")
        .when(label.rlike(STEP), F.when(rates == 0, "non_wage").when(active, "step_row").otherwise("ambiguous_step"))
        .when(is_class_label(label) & (rates < many), "classification_header").when(rates >= many, "rate_row").when(rates > 0, "ambiguous_rate_like").otherwise("non_wage")
    )


def scan(rows: DataFrame, doc: str, at: str, cells: str, expected: int) -> DataFrame:
    """Adds active_class, dates and row_type: classes and dates hold until the next ones, across a document's tables."""
    w = Window.partitionBy(doc).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    label = clean(F.get(cells, F.lit(0)))
    first = rows.withColumn("_t", row_type(F.col(cells), expected, F.lit(True)))
    active = F.last(F.when(F.col("_t") == "classification_header", label), True).over(w)
    dates = F.last(F.when(F.col("_t") == "effective_date", F.array_join(F.regexp_extract_all(F.array_join(cells, " "), F.lit(f"({DATE})"), F.lit(1)), ",")), True).over(w)
    told = first.withColumn("active_class", active).withColumn("dates", dates)
    return told.withColumn("row_type", F.when((F.col("_t") == "step_row") & F.col("active_class").isNull(), "ambiguous_step").otherwise(F.col("_t"))).drop("_t")
