"""The training-corpus pipeline: five stages over documents, each one an operator of brindle.llm.

Each stage gets the documents that its predecessor kept and returns the columns of documents; the last one returns
pieces of documents with their bins. run() writes every stage as Parquet in the shared folder and reads it again; what
a stage's operators and its predecessor have written there goes once the stage is written.

Defined results: null texts count as empty; rows that repeat an id stay or go together; rows without an id are judged by
their texts alone and are never near duplicates; an empty table passes through; further columns stay, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import classifier, jaccard, packing, secrets, suffix
from brindle.llm.common import Scratch, fresh, released

#: Near duplicates: five words a shingle, a similarity of 80 percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def _counted(docs: DataFrame) -> DataFrame:
    """Brings n_chars up to date, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects."""
    weights = classifier.train(docs, _labels(spark, sf_dir))
    (score,) = fresh(docs.columns, "_score")
    return classifier.score(docs, weights, score_col=score).filter(F.col(score) >= classifier.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    found = jaccard.similar_texts(docs, n_words=NEAR_WORDS, threshold=NEAR_PERCENT)
    (id_,) = fresh(docs.columns, "_gone")
    gone = found.filter("component_id < doc_id").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[id_], "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes and more that stand earlier; drops documents of which nothing is left."""
    (had,) = fresh(docs.columns, "_had")
    cut = suffix.strip(docs.withColumn(had, F.length(F.trim("text")) > 0), suffix.find_repeats(docs))
    return _counted(cut.filter(~F.coalesce(had, F.lit(False)) | (F.length(F.trim("text")) > 0)).select(*docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [SECRET]."""
    (spans,) = fresh(docs.columns, "_spans")
    found = docs.withColumn(spans, secrets.scan(F.col("text")))
    return _counted(found.withColumn("text", secrets.redact("text", spans)).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scans", secret_scans),
    ("best_fit_packing", packed),
]

#: SQL can't express a classifier or a best-fit search; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
