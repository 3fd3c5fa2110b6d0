"""Keyword, vector and fused ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import runs, tokens
from ..functions.vectors import cosine

K1, B, RRF_K, MISSING_RANK = 1.8, 0.75, 60, 999


def bm25(df: DataFrame, text: str, terms: list[str], tf_mode: str = "binary", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores of the documents that hold a term. ``tf_mode``: 'binary' counts a term once a document, 'count' as often as it occurs.

    A repeated query term counts again. Two passes over the texts, no posting shuffle: counts of documents, lengths and
    terms are one row; the second pass scores against it.
    """
    distinct = list(dict.fromkeys(terms))
    counted = df.select(*keep, tokens(F.coalesce(text, F.lit(""))).alias("_tokens"))
    tf = lambda t: F.size(F.filter("_tokens", lambda w: w == t)).cast("double")
    held = counted.select(*keep, F.size("_tokens").alias("_len"), *[tf(t).alias(f"_tf{i}") for i, t in enumerate(distinct)])
    stats = held.agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"),
        *[F.sum((F.col(f"_tf{i}") > 0).cast("bigint")).alias(f"_df{i}") for i in range(len(distinct))],
    )
    # No filter on the counts: pushed below the projection it would split each text into tokens once more.
    joined = held.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for t in terms:
        i = distinct.index(t)
        f = F.when(F.col(f"_tf{i}") > 0, 1.0).otherwise(0.0) if tf_mode == "binary" else F.col(f"_tf{i}")
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1.0)
        score = score + idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * (F.col("_len") / F.col("_avg")))))
    return joined.select(*keep, F.round(score, 6).alias("score")).filter("score > 0")


def postings(df: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """term, key, tf and the document's length in tokens: the index to store once and to query many times."""
    counted = df.select(key, tokens(F.coalesce(text, F.lit(""))).alias("_tokens")).withColumn("len", F.size("_tokens").cast("bigint"))
    return counted.select(key, "len", F.explode("_tokens").alias("term")).groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("tf")).select("term", key, "tf", "len")


def bm25_indexed(index: DataFrame, n_docs: Column, mean_length: Column, terms: list[str], key: str = "doc_id", tf_mode: str = "binary") -> DataFrame:
    """Scores from stored postings: only rows of the query's terms are read; ``n_docs`` and ``mean_length`` are scalars of the corpus."""
    asked = index.sparkSession.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, times int")
    hits = index.filter(F.col("term").isin(*dict.fromkeys(terms))).join(F.broadcast(asked), "term")
    df_of = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row per term of the query
    f = F.lit(1.0) if tf_mode == "binary" else F.col("tf").cast("double")
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    each = F.col("times") * idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * (F.col("len") / mean_length))))
    return hits.join(F.broadcast(df_of), "term").groupBy(key).agg(F.round(F.sum(each), 6).alias("score")).filter("score > 0")


def top(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def nearest(df: DataFrame, vector: Column, query: Column, name: str = "score") -> DataFrame:
    """Adds the exact cosine to the query, rounded."""
    return df.withColumn(name, F.round(cosine(vector, query), 6))


def fuse(lists: list[tuple[DataFrame, float]], key: str, score: str, k: int = RRF_K, places: int | None = 8) -> DataFrame:
    """Reciprocal rank fusion of top-k lists: rank per list (MISSING_RANK where absent) and the weighted sum.

    A list of weight 0 still contributes its rows.
    """
    ranked = None
    for i, (one, weight) in enumerate(lists):
        part = one.select(key, F.row_number().over(Window.orderBy(F.col(score).desc(), key)).alias("_rank"), F.lit(i).alias("_list"), F.lit(float(weight)).alias("_weight"))
        ranked = part if ranked is None else ranked.unionByName(part)
    ranks = [F.coalesce(F.min(F.when(F.col("_list") == i, F.col("_rank"))), F.lit(MISSING_RANK)).cast("bigint").alias(f"rank_{i + 1}") for i in range(len(lists))]
    rrf = F.sum(F.col("_weight") / (F.lit(k) + F.col("_rank")))
    return ranked.groupBy(key).agg(*ranks, (rrf if places is None else F.round(rrf, places)).alias("rrf"))


def group_rerank(df: DataFrame, group: str, section: str, score: str, key: str, text: str, terms: list[str], limit: int = 5, section_bonus: float = 0.35, hit_bonus: float = 0.12) -> DataFrame:
    """The single best row, then rows by their group's score and their own; ``limit`` rows with their place.

    A group's score is the sum of its three best scores, a bonus for each of up to three sections and one for each term
    that the texts of its four best rows hold. Sections are partial aggregates; only four rows a group are ranked.
    """
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
    best = df.withColumn("_r", F.row_number().over(w)).filter("_r <= 4").groupBy(group).agg(
        F.sum(F.when(F.col("_r") <= 3, F.col(score))).alias("_top"), F.lower(F.array_join(F.array_agg(F.substring(F.coalesce(text, F.lit("")), 1, 1200)), " ")).alias("_text"),
    )
    hits = reduce(lambda a, b: a + b, [F.col("_text").contains(t).cast("int") for t in terms], F.lit(0))
    sections = df.groupBy(group).agg(F.least(F.count_distinct(section), F.lit(3)).alias("_sections"))
    scored = best.join(sections, group).select(group, F.round(F.col("_top") + section_bonus * F.col("_sections") + hit_bonus * hits, 6).alias("group_score"))
    first = df.orderBy(F.col(score).desc(), key).limit(1).select(F.col(key).alias("_first"))
    order = [(F.col(key) == F.col("_first")).desc(), F.col("group_score").desc(), F.col(group), F.col(score).desc(), F.col(key)]
    ranked = df.join(scored, group).crossJoin(F.broadcast(first)).orderBy(*order).limit(limit)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).drop("_first")


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """(key, dim, weight): runs of a-z and 0-9 hashed to an index and a sign by SHA-256, summed, of length 1; zeros are left out.

    Equal tokens of a text are counted first, so that each is hashed once.
    """
    t = df.select(key, F.explode(runs(F.coalesce(text, F.lit("")))).alias("_w")).groupBy(key, "_w").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.sha2("_w", 256))
    dim = F.conv(F.substring("_h", 1, 4), 16, 10).cast("bigint") % dimensions
    sign = F.when(F.conv(F.substring("_h", 5, 2), 16, 10).cast("int") % 2 == 0, F.col("_n")).otherwise(-F.col("_n"))
    g = t.groupBy(key, dim.alias("dim")).agg(F.sum(sign).alias("_v")).filter("_v != 0")
    length = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(key)))  # at most ``dimensions`` rows a key
    return g.select(key, "dim", (F.col("_v") / length).alias("weight"))


def hybrid(dense: DataFrame, keyword: DataFrame, key: str, cosine_col: str, weights: tuple[float, float], n: int, after: Column | None = None, boost: Column | None = None, least: float = 0.1) -> DataFrame:
    """Fused search: the top 2n of either arm, ``after`` as a filter on them, ranks and weights, boosts, the first n.

    ``dense`` has a row per document with its cosine and all that filters and boosts need, ``keyword`` a score.
    """
    one = top(dense.filter(F.col(cosine_col) >= least), cosine_col, key, 2 * n)
    two = top(keyword, "score", key, 2 * n)
    if after is not None:
        one, two = one.filter(after), two.filter(after)
    fused = fuse([(one.withColumnRenamed(cosine_col, "score"), weights[0]), (two, weights[1])], key, "score", places=None)
    told = dense.join(F.broadcast(fused), key)  # at most 4n rows
    score = F.col("rrf") if boost is None else F.col("rrf") + boost
    return top(told.select(key, F.col("rank_1").alias("dense_rank"), F.col("rank_2").alias("keyword_rank"), F.round(score, 8).alias("score")), "score", key, n)


def article_boost(preferred: Column) -> Column:
    return F.when(preferred, 0.08).otherwise(-0.01)


def table_boost(has_tables: Column, appendix: Column, low: Column) -> Column:
    """For questions after values: rows with tables, of an appendix, or with an amount or a date in their first 800 characters."""
    zero = F.lit(0.0)
    return F.when(has_tables, 0.06).otherwise(zero) + F.when(appendix, 0.03).otherwise(zero) + F.when(F.substring(low, 1, 800).rlike("[$]|effective|after "), 0.02).otherwise(zero)


def letter_boost(is_letter: Column, phrase: Column, hits: list[Column], cue: Column, mode: str) -> Column:
    zero = F.lit(0.0)
    focus = F.least(F.lit(0.08), 0.02 * reduce(lambda a, b: a + b, [h.cast("int") for h in hits], F.lit(0)))
    followup = F.when(cue, 0.05).otherwise(zero) if mode == "followup" else zero
    return F.when(is_letter, 0.08 if mode == "explicit" else 0.06).otherwise(zero) + F.when(phrase, 0.01).otherwise(zero) + focus + followup


def metadata_boost(article: Column, section: Column, preferred: Column, own_class: Column, all_classes: Column, topic: Column, stakes: Column) -> Column:
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    by_class = F.when(own_class, 0.15).when(~all_classes, -0.05).otherwise(0.0)
    return add(article, 0.3) + add(section, 0.1) + add(preferred, 0.2) + by_class + add(topic, 0.15) + add(stakes, 0.1)
