"""Questions and clauses made from orders and parts, on which the operators for contract questions run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: {a} is an article, {h} a number of hours, {m} of months.
QUESTIONS = (
    "What is my pay after {h} hours?", "How much does a head clerk make with {m} months of service?", "I was just fired today by my manager", "What if I was suspended for being late?",
    "Does Article {a} Section 4 cover vacation accrual for {m} months?", "What is the rate of pay for overtime under article {a}?", "My boss is harassing me right now",
    "Can either party cancel that agreement with 30 days written notice?", "Is there a letter of understanding on scheduling?", "How many sick days do I get after {m} months",
    "What are the hours between the end of a shift and the start of the next?", "In addition to the hourly rate, what premium shall be paid per Section {a}?", "Who's on the joint labor committee?",
    "Tell me about funeral leave", "What does the pay stub show?", "Could I be terminated during probation within {h} hours?", "Compare the difference between a head clerk and a courtesy clerk",
    "what's my pay as a baker at {h} hours", "When does the contract expire?", "How do I file a grievance about an unsafe ladder?", "Is $15 the minimum wage in Colorado for an hour of work?", "   ",
    "Am I eligible for health insurance at {m} months?", "Explain article {a} and ARTICLE 12 and section 3",
)
CLAUSES = (
    "Article {a} Section 2. Employees shall receive ${r} per hour. See Article 7 and article {a}.", "The employer and the union agree that vacation is 2 weeks after 12 months of service, see Article 14b.",
    "Memo to: all staff. Shifts are posted 10 days ahead.", "Notice: effective immediately, overtime of {a} hours per week is paid at 150%.", "Handbook policy on sick leave and insurance, {a}% covered.",
    "Plain words about a garden.",
)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    text = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("o_orderkey") % len(QUESTIONS) + 1).cast("int"))
    for mark, number in (("{a}", F.col("o_custkey") % 60), ("{h}", F.col("o_orderkey") % 4000), ("{m}", F.col("o_orderkey") % 70)):
        text = F.replace(text, F.lit(mark), number.cast("string"))
    return o.select(F.col("o_orderkey").alias("q_id"), text.alias("question"))


def clauses(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    text = F.element_at(F.array(*[F.lit(c) for c in CLAUSES]), (F.col("p_partkey") % len(CLAUSES) + 1).cast("int"))
    for mark, value in (("{a}", F.col("p_size").cast("string")), ("{r}", F.format_string("%d.50", F.col("p_size") + 10))):
        text = F.replace(text, F.lit(mark), value)
    return p.select(F.col("p_partkey").alias("clause_id"), F.col("p_size").alias("article"), F.col("p_name").alias("title"), text.alias("text"))


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


QUESTIONS_SQL = f"""q AS (SELECT o_orderkey AS q_id, replace(replace(replace({_listed(QUESTIONS)}[o_orderkey % {len(QUESTIONS)} + 1], '{{a}}', CAST(o_custkey % 60 AS VARCHAR)),
'{{h}}', CAST(o_orderkey % 4000 AS VARCHAR)), '{{m}}', CAST(o_orderkey % 70 AS VARCHAR)) AS question FROM orders)"""
CLAUSES_SQL = f"""c AS (SELECT p_partkey AS clause_id, p_size AS article, p_name AS title, replace(replace({_listed(CLAUSES)}[p_partkey % {len(CLAUSES)} + 1], '{{a}}', CAST(p_size AS VARCHAR)),
'{{r}}', CAST(p_size + 10 AS VARCHAR) || '.50') AS text FROM part)"""
