from pyspark.sql import functions as F

from brindle.operators import acceptance
from brindle.plans import packs


def test_every_check_passes_and_fails_somewhere(spark):
    """Packs of the same tables, of which each lacks what its number says."""
    parts = spark.range(40 * 700).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id") % 64).alias("p_name"), F.concat(F.lit("type "), F.col("id") % 6).alias("p_type"), (F.col("id") % 50 + 1).alias("p_size"))
    tables = {name: parts.filter(rows).selectExpr(*packs._columns(columns)) for name, (columns, rows) in packs.TABLES.items()}
    asked = parts.selectExpr("CAST(floor(p_partkey / 40) AS BIGINT) AS contract").distinct()
    results = acceptance.evaluate(asked, tables).cache()
    told = {r.check_id: (r.passed, r.failed) for r in results.groupBy("check_id").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")).collect()}
    assert set(told) == {c.check_id for c in acceptance.CHECKS} and len(told) == len(acceptance.CHECKS)
    assert {k for k, (p, f) in told.items() if not p or not f} == set()
    cards = {r.contract: r for r in acceptance.scorecard(results).collect()}
    strict = {r.contract: r.accepted for r in acceptance.scorecard(results, strict=True).collect()}
    assert 0 < sum(r.accepted for r in cards.values()) < 700 and all(cards[k].accepted or not strict[k] for k in strict)
    assert all(strict[k] == (r.required_failed == [] == r.advisory_failed) for k, r in cards.items())


def test_nulls_missing_rows_and_shares(spark):
    checks = (
        acceptance.Measure("some", "a", "count(*)", "x > 0"), acceptance.Measure("rate", "a", "avg(CASE WHEN v > 1 THEN 1.0 ELSE 0.0 END)", "x >= 0.5", "advisory"),
        acceptance.Measure("lenient", "a", "avg(CASE WHEN v > 9 THEN 1.0 ELSE 0.0 END)", "coalesce(x, 0) <= 0.1", "advisory"),
        acceptance.Reference("refs", "a", "v", "b", "w"), acceptance.Reference("share", "a", "v", "b", "w", "x >= 0.5", share=True),
    )
    df = lambda rows, cols: spark.createDataFrame(rows, cols)
    a = df([(1, 1), (1, 2), (1, 2), (1, None), (2, 5), (4, None)], "contract int, v int")
    b = df([(1, 2), (1, 2), (1, None), (2, 9)], "contract int, w int")
    got = {(r.contract, r.check_id): (r.passed, r.metric) for r in acceptance.evaluate(df([(1,), (1,), (2,), (3,), (4,)], "contract int"), {"a": a, "b": b}, checks).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {"some": (True, 4.0), "rate": (True, 0.5), "lenient": (True, 0.0), "refs": (False, 1.0), "share": (True, 0.5)}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"some": (True, 1.0), "rate": (True, 1.0), "lenient": (True, 0.0), "refs": (False, 1.0), "share": (False, 0.0)}
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {"some": (False, 0.0), "rate": (False, None), "lenient": (True, None), "refs": (True, 0.0), "share": (False, None)}
    assert {k[1]: v for k, v in got.items() if k[0] == 4}["share"] == (False, None)
