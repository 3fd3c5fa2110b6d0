"""Stored vectors, merged metadata, and chunks of contracts that are plain text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import articles, metadata
from ..sources.postings import _root
from ..sources.tables import table
from ..sources.vector_sink import VectorSink
from .registry import Registry

registry = Registry()


def _sink(spark: SparkSession, sf: str, told: list | None = None) -> VectorSink:
    """Vectors written, changed, deleted, brought back, compacted and added to; ``told`` gets the count behind each step."""
    e, v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), F.col("vec_id")
    sink = VectorSink(spark, f"{_root(spark)}/brindle-sink-{uuid.uuid4().hex}", "vec_id bigint, label int, embedding array<float>", "vec_id")
    steps = [
        ("written", lambda: sink.upsert(e)), ("changed", lambda: sink.upsert(e.filter(v % 7 == 3).withColumn("label", F.col("label") + 100))), ("deleted", lambda: sink.delete(e.filter(v % 11 == 5))),
        ("brought_back", lambda: sink.upsert(e.filter(v % 22 == 5).withColumn("label", F.lit(-1)))), ("compacted", sink.compact), ("added", lambda: sink.upsert(e.filter(v % 50 == 0).withColumn("vec_id", v + 1_000_000))),
    ]
    for name, step in steps:
        step()
        if told is not None:
            told.append((name, sink.count()))
    return sink


LIVE = """live AS (SELECT vec_id, CASE WHEN vec_id % 22 = 5 THEN -1 WHEN vec_id % 7 = 3 THEN label + 100 ELSE label END AS label, len(embedding) AS dims FROM embeddings WHERE vec_id % 11 <> 5 OR vec_id % 22 = 5
UNION ALL SELECT vec_id + 1000000, label, len(embedding) FROM embeddings WHERE vec_id % 50 = 0)"""


@registry.query(f"WITH {LIVE} SELECT vec_id, label, CAST(dims AS BIGINT) AS dims FROM live")
def vector_sink_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _sink(spark, sf).current().select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims"))


@registry.query(f"WITH {LIVE} SELECT vec_id, label FROM live WHERE vec_id IN (0, 3, 5, 10, 16, 27, 38, 50, 1000000, 1000050, 999)")
def vector_sink_get(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by their ids, from their buckets alone."""
    return _sink(spark, sf).get([0, 3, 5, 10, 16, 27, 38, 50, 1_000_000, 1_000_050, 999]).select("vec_id", "label")


@registry.query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 11 = 5) AS gone, count(*) FILTER (vec_id % 22 = 5) AS back, count(*) FILTER (vec_id % 50 = 0) AS more FROM embeddings)
SELECT 'written' AS step, n AS live FROM c UNION ALL SELECT 'changed', n FROM c UNION ALL SELECT 'deleted', n - gone FROM c UNION ALL SELECT 'brought_back', n - gone + back FROM c UNION ALL SELECT 'compacted', n - gone + back FROM c UNION ALL SELECT 'added', n - gone + back + more FROM c""")
def vector_sink_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The number of live vectors behind each step, from the commits alone."""
    told: list = []
    _sink(spark, sf, told)
    return spark.createDataFrame(told, "step string, live bigint")


#: Three documents of each part: nested, with a null, an array, a value over an object and an object over a value.
_DOCS = [
    """concat('{"name": "', p_name, '", "size": ', p_size, ', "rate": {"base": ', p_size * 2, ', "step": {"a": 1, "b": null}}, "tags": ["x", "', p_type, '"]}')""",
    """concat('{"rate": {"base": ', p_size + 1, if(p_partkey % 2 = 0, ', "step": 7', ''), '}, "size": ', if(p_partkey % 3 = 0, 'null', '{"min": 1, "max": 2}'), '}')""",
    """concat('{"tags": ', if(p_partkey % 5 = 0, '{}', '[]'), if(p_partkey % 4 = 0, ', "rate": {"step": {"c": "late"}}', ''), ', "brand": "', p_brand, '"}')""",
]


def _docs_sql() -> str:
    import re

    each = [re.sub(r"if\(([^,]+), ('[^']*'), ('[^']*')\)", r"CASE WHEN \1 THEN \2 ELSE \3 END", d) for d in _DOCS]
    return " UNION ALL ".join(f"SELECT p_partkey, {i + 1} AS o, {d} AS j FROM part" for i, d in enumerate(each))


@registry.query(f"""WITH d AS ({_docs_sql()}), t AS (SELECT p_partkey, o, substr(fullkey, 3) AS p, CAST(value AS VARCHAR) AS v FROM (SELECT p_partkey, o, unnest(x) AS x FROM (SELECT p_partkey, o, (SELECT list(struct_pack(fullkey := t.fullkey, value := t.value, type := t.type)) FROM json_tree(d.j) t) AS x FROM d)) u, LATERAL (SELECT u.x.fullkey AS fullkey, u.x.value AS value, u.x.type AS type) WHERE type <> 'OBJECT' AND NOT contains(fullkey, '[')),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, p ORDER BY o DESC) AS r FROM t WHERE p <> '')
SELECT p_partkey, p AS path, v AS value FROM n a WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.p_partkey = a.p_partkey AND b.o > a.o AND (starts_with(b.p, a.p || '.') OR starts_with(a.p, b.p || '.')))""")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of parts from three sources merged by path, the later one over the one before."""
    p = table(spark, sf, "part")
    docs = None
    for i, d in enumerate(_DOCS):
        one = p.select("p_partkey", F.lit(i + 1).alias("o"), F.expr(d).alias("j"))
        docs = one if docs is None else docs.unionByName(one)
    merged = metadata.merge_later_wins(docs, "p_partkey", "o", "j")
    return merged.select("p_partkey", F.array_join("path", ".").alias("path"), "value")


TITLES = ["RECOGNITION", "HOURS OF WORK", "WAGES", "VACATIONS", "HOLIDAYS", "LEAVES", "SENIORITY", "TERM, AND RENEWAL"]


def contract_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(contract, text): eight articles of five sections from forty parts, behind a table of contents, with a heading that one article names and a letter."""
    article, section = F.expr("p_partkey % 40 div 5 + 1"), F.col("p_partkey") % 5 + 1
    head = F.when(section == 1, F.concat(F.lit("# ARTICLE "), article, F.lit("\n## "), F.element_at(F.array(*[F.lit(t) for t in TITLES]), article.cast("int")), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("Section "), section, F.lit(". "), "p_name", F.lit(" is paid by the "), "p_type", F.lit(" rate."))
    tail = F.when((article == 3) & (section == 5), "\n# ARTICLE 7 applies here as well").when((article == 8) & (section == 5), F.concat(F.lit("\n# LETTERS OF UNDERSTANDING\n1. Night Work\nWork at night in "), "p_brand", F.lit(" is paid as it was agreed.")))
    p = table(spark, sf, "part").select(F.expr("p_partkey div 40").alias("contract"), "p_partkey", F.concat(head, body, F.coalesce(tail, F.lit(""))).alias("text"))
    contents = "CONTENTS\n" + "\n".join(f"# ARTICLE {i + 1} {t}" for i, t in enumerate(TITLES)) + "\nLETTERS OF UNDERSTANDING ... 40\n"
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("contract").agg(F.concat(F.lit(contents), lines).alias("text"))


@registry.query(f"""WITH p AS (SELECT p_partkey // 40 AS contract, (p_partkey % 40) // 5 + 1 AS a, p_partkey % 5 + 1 AS s, * FROM part)
SELECT contract, 'art' || a || '_sec' || s AS chunk_id, [{", ".join(f"'{t}'" for t in TITLES)}][CAST(a AS INT)] AS title, 'Article ' || a || ', Section ' || s AS citation, p_name || ' is paid by the ' || p_type || ' rate.' || CASE WHEN a = 3 AND s = 5 THEN chr(10) || '# ARTICLE 7 applies here as well' ELSE '' END AS content FROM p
UNION ALL SELECT contract, 'lou_1', 'Letter of Understanding 1: Night Work', 'Letter of Understanding 1', 'Work at night in ' || p_brand || ' is paid as it was agreed.' FROM p WHERE a = 8 AND s = 5""")
def plain_contract_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of contracts whose articles have to be told from a table of contents and from mentions."""
    return articles.chunks(contract_texts(spark, sf), "contract", "text").select("contract", "chunk_id", "title", "citation", "content")
