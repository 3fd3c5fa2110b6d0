"""Keyword, vector and fused retrieval over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import search, sequences, windows
from ..sources import postings
from ..sources.tables import table
from .registry import Registry

registry = Registry()
TERMS = ["the", "and", "tion", "the"]
QUESTION = "the thing that was in the time of and on"

TOK = r"""tok AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{2,}')) AS w FROM documents)"""


def _bm25_sql(count: bool) -> str:
    tf = lambda t: f"len(list_filter(w, lambda x: x = '{t}'))"
    distinct = list(dict.fromkeys(TERMS))
    f = lambda i: f"CAST(tf{i} AS DOUBLE)" if count else f"(CASE WHEN tf{i} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    score = " + ".join(
        f"ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1.0::DOUBLE) * ({f(i)} * 2.8::DOUBLE / ({f(i)} + 1.8::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len / al))))"
        for i in (distinct.index(t) for t in TERMS)
    )
    return f"""{TOK}, h AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS len, {", ".join(f"{tf(t)} AS tf{i}" for i, t in enumerate(distinct))} FROM tok),
s AS (SELECT count(*) AS n, avg(len) AS al, {", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(distinct)))} FROM h),
bm AS (SELECT doc_id, round({score}, 6) AS score FROM h, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(distinct)))})"""


def _bm25(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return search.top(search.bm25(table(spark, sf, "documents"), "text", TERMS, mode), "score", "doc_id", 10)


@registry.query(f"WITH {_bm25_sql(False)} SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_binary_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, "binary")


@registry.query(f"WITH {_bm25_sql(True)} SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_count_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, "count")


@registry.query(f"WITH {TOK} SELECT lang, count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(w))) AS BIGINT) AS postings, round(avg(len(w)), 6) AS avg_len FROM tok GROUP BY lang")
def bm25_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("lang", T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("w")).alias("tokens"),
        F.sum(F.size(F.array_distinct("w"))).alias("postings"), F.round(F.avg(F.size("w")), 6).alias("avg_len"),
    )


@registry.query(f"WITH {TOK}, t AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def bm25_term_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and occurrences of every term: per document first, so that a frequent term is pre-aggregated."""
    t = table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("term"))
    per = t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("df"))


def _scored(spark: SparkSession, sf: str, query_id: int = 0) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.filter(F.col("vec_id") == query_id).select(F.col("embedding").alias("q"))
    return search.nearest(e.crossJoin(F.broadcast(q)), F.col("embedding"), F.col("q")).select("vec_id", "label", "score")


def _cos_sql(query_id: int = 0) -> str:
    return f"""(SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) /
(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {query_id}) q)"""


@registry.query(f"SELECT vec_id, score FROM {_cos_sql()} ORDER BY score DESC, vec_id LIMIT 10")
def dense_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(_scored(spark, sf).select("vec_id", "score"), "score", "vec_id", 10)


@registry.query(f"""SELECT vec_id, label, round(score + CASE WHEN label = 3 THEN 0.3 ELSE 0 END + CASE WHEN label IN (1, 2) THEN 0.2 ELSE 0 END
+ CASE WHEN vec_id % 2 = 0 THEN 0.15 ELSE -0.05 END, 6) AS boosted FROM {_cos_sql()} WHERE score >= 0.1""")
def dense_threshold_boosts(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).filter("score >= 0.1")
    boost = F.when(F.col("label") == 3, 0.3).otherwise(0.0) + F.when(F.col("label").isin(1, 2), 0.2).otherwise(0.0) + F.when(F.col("vec_id") % 2 == 0, 0.15).otherwise(-0.05)
    return s.select("vec_id", "label", F.round(F.col("score") + boost, 6).alias("boosted"))


def _rrf_sql(w1: float, w2: float) -> str:
    return f"""WITH {_bm25_sql(False)}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm WHERE score > 0 ORDER BY r LIMIT 20),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY r LIMIT 20)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.r, 999) AS rank_1, coalesce(b.r, 999) AS rank_2,
round(coalesce({w1}::DOUBLE / (60 + a.r), 0) + coalesce({w2}::DOUBLE / (60 + b.r), 0), 8) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id"""


def _rrf(spark: SparkSession, sf: str, w1: float, w2: float) -> DataFrame:
    docs = table(spark, sf, "documents")
    keyword = search.top(search.bm25(docs, "text", TERMS), "score", "doc_id", 20)
    long = search.top(docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), "score", "doc_id", 20)
    return search.fuse([(keyword, w1), (long, w2)], "doc_id", "score")


@registry.query(_rrf_sql(1.0, 0.5))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rrf(spark, sf, 1.0, 0.5)


@registry.query(_rrf_sql(1.0, 0.0))
def rrf_weighted_zero_arm(spark: SparkSession, sf: str) -> DataFrame:
    return _rrf(spark, sf, 1.0, 0.0)


@registry.query(f"SELECT vec_id, max(score) AS score FROM (SELECT * FROM {_cos_sql(0)} UNION ALL SELECT * FROM {_cos_sql(1)} UNION ALL SELECT * FROM {_cos_sql(2)}) GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 10")
def multi_angle_max_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The best score over three queries; one pass over the vectors."""
    e = table(spark, sf, "embeddings")
    q = e.filter(F.col("vec_id").isin(0, 1, 2)).agg(F.collect_list("embedding").alias("qs"))
    best = F.array_max(F.transform("qs", lambda v: F.round(cosine(F.col("embedding"), v), 6)))
    return search.top(e.crossJoin(F.broadcast(q)).select("vec_id", best.alias("score")), "score", "vec_id", 10)


@registry.query(f"SELECT vec_id, round(0.3 * score + 0.7 * least(greatest(label, 1), 10) / 10, 6) AS blended FROM {_cos_sql()} ORDER BY blended DESC, vec_id LIMIT 20")
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    given = F.least(F.greatest(F.coalesce("label", F.lit(5)), F.lit(1)), F.lit(10))
    return search.top(s.select("vec_id", F.round(0.3 * F.col("score") + 0.7 * given / 10, 6).alias("blended")), "blended", "vec_id", 20)


GROUP_TERMS = ["tion", "zzzz", "ing", "ción"]


@registry.query(f"""WITH s AS (SELECT v.*, vec_id % 7 AS section, coalesce(d.text, '') AS text, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM {_cos_sql()} v LEFT JOIN documents d ON d.doc_id = v.vec_id),
g AS (SELECT label, sum(CASE WHEN r <= 3 THEN score ELSE 0 END) AS t, least(count(DISTINCT section), 3) AS n, lower(string_agg(CASE WHEN r <= 4 THEN substr(text, 1, 1200) ELSE '' END, ' ')) AS x FROM s GROUP BY label),
o AS (SELECT label, round(t + 0.35::DOUBLE * n + 0.12::DOUBLE * ({" + ".join(f"CAST(contains(x, '{t}') AS INTEGER)" for t in GROUP_TERMS)}), 6) AS group_score FROM g),
p AS (SELECT vec_id, s.label, score, group_score, row_number() OVER (ORDER BY vec_id = (SELECT vec_id FROM s ORDER BY score DESC, vec_id LIMIT 1) DESC, group_score DESC, s.label, score DESC, vec_id) AS place FROM s JOIN o USING (label))
SELECT vec_id, label, score, group_score, place FROM p WHERE place <= 5""")
def article_group_rerank(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = _scored(spark, sf).withColumn("section", F.col("vec_id") % 7).join(texts, "vec_id", "left")
    return search.group_rerank(rows, "label", "section", "score", "vec_id", "text", GROUP_TERMS).select("vec_id", "label", "score", "group_score", "place")


@registry.query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, contains(text, 'ion ') AS hit FROM conversations)
SELECT DISTINCT a.conv_id, a.turn, a.role FROM t a JOIN t h ON a.conv_id = h.conv_id AND h.hit AND a.p BETWEEN h.p - 2 AND h.p + 5""")
def context_window_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return windows.neighbourhood(c, ["conv_id"], "turn", F.col("text").contains("ion "), 2, 5).select("conv_id", "turn", "role").distinct()


@registry.query("""WITH u AS (SELECT c_custkey, 0 AS l, r FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 8
UNION ALL SELECT c_custkey, 1, r FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r <= 10),
f AS (SELECT c_custkey, min(l * 1000 + r) AS o FROM u GROUP BY c_custkey)
SELECT c_custkey, row_number() OVER (ORDER BY o, c_custkey) AS place FROM f ORDER BY place LIMIT 12""")
def ordered_unique_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    rich = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(8).withColumn("o", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")))
    first = c.orderBy("c_custkey").limit(10).withColumn("o", F.row_number().over(Window.orderBy("c_custkey")))
    return windows.ordered_merge([rich, first], "c_custkey", "o", 12)


@registry.query(f"""WITH q AS (SELECT list_distinct(string_split('{QUESTION}', ' ')) AS q),
b AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)
SELECT doc_id, round(CAST(len(list_intersect(w, q)) AS DOUBLE) / (len(w) + len(q) - len(list_intersect(w, q))), 6) AS similarity FROM b, q
WHERE CAST(len(list_intersect(w, q)) AS DOUBLE) / (len(w) + len(q) - len(list_intersect(w, q))) > 0.1""")
def jaccard_question_match(spark: SparkSession, sf: str) -> DataFrame:
    asked = sorted(set(QUESTION.split(" ")))
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    w = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))
    # One pass over the words gives both sizes.
    sizes = F.aggregate(w, F.struct(F.lit(0).alias("n"), F.lit(0).alias("both")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["both"] + x.isin(*asked).cast("int")).alias("both")))
    s = F.col("s.both") / (F.col("s.n") + len(asked) - F.col("s.both"))
    return d.select("doc_id", sizes.alias("s")).withColumn("similarity", s).filter("similarity > 0.1").select("doc_id", F.round("similarity", 6).alias("similarity"))


@registry.query(f"""SELECT doc_id, array_to_string(list_transform(generate_series(1, least(8, len(t))), lambda i: t[i]), ' ') AS terms FROM (
SELECT doc_id, list_transform(list_sort(list_transform(map_entries(m), lambda e: {{'p': e.value, 'w': e.key}})), lambda s: s.w) AS t FROM (
SELECT doc_id, map_from_entries(list_transform(list_distinct(f), lambda w: {{'k': w, 'v': list_position(f, w)}})) AS m FROM (
SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(string_split('{" ".join(T.STOPWORDS)}', ' '), w)) AS f FROM documents)))""")
def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.search_terms(F.coalesce("text", F.lit(""))), " ").alias("terms"))


HASHED_SQL = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS w FROM documents UNION ALL SELECT -1, unnest(regexp_extract_all('the thing that was in café Überstunde', '[a-z0-9]{2,}'))),
c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY doc_id, w), h AS (SELECT doc_id, n, CAST('0x' || substr(sha256(w), 1, 4) AS BIGINT) % 384 AS dim, CASE WHEN CAST('0x' || substr(sha256(w), 5, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM c),
g AS (SELECT doc_id, dim, sum(s * n) AS v FROM h GROUP BY doc_id, dim), l AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM g GROUP BY doc_id),
e AS (SELECT g.doc_id, dim, v / l AS weight FROM g JOIN l USING (doc_id) WHERE v <> 0)"""


@registry.query(f"WITH {HASHED_SQL} SELECT doc_id, dim, round(weight, 6) AS weight FROM e WHERE doc_id >= 0")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse hashed embeddings of whole texts: index and sign by SHA-256, of length 1."""
    e = search.hash_embedding(table(spark, sf, "documents"), "doc_id", "text")
    return e.select("doc_id", "dim", F.round("weight", 6).alias("weight"))


@registry.query(f"WITH {HASHED_SQL} SELECT e.doc_id, round(sum(e.weight * q.weight), 6) AS similarity FROM e JOIN e q ON q.doc_id = -1 AND e.dim = q.dim WHERE e.doc_id >= 0 GROUP BY e.doc_id ORDER BY similarity DESC, e.doc_id LIMIT 10")
def hash_embed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The texts nearest to a question: its few hashed weights are broadcast and met on the index."""
    docs = search.hash_embedding(table(spark, sf, "documents"), "doc_id", "text")
    asked = spark.createDataFrame([(-1, "the thing that was in café Überstunde")], "doc_id bigint, text string")
    q = search.hash_embedding(asked, "doc_id", "text").select("dim", F.col("weight").alias("asked"))
    near = docs.join(F.broadcast(q), "dim").groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.col("asked")), 6).alias("similarity"))
    return search.top(near, "similarity", "doc_id", 10)


@registry.query("""WITH q AS (SELECT '  antique steel  ' AS q), t AS (SELECT p_partkey, '  ' || lower(trim(p_name)) || '  ' AS s FROM part),
g AS (SELECT p_partkey, list_distinct(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3))) AS a, list_distinct(list_transform(generate_series(1, length(q) - 2), lambda i: substr(q, i, 3))) AS b FROM t, q)
SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM g""")
def fuzzy_trigram_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(T.token_sets_jaccard(T.trigrams(F.col("p_name")), T.trigrams(F.lit("antique steel"))), 6).alias("similarity"))


@registry.query()
def fuzzy_sequence_match(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of every part name to a term by matching blocks; the tests compute it pair by pair."""
    p = table(spark, sf, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("s"))
    return p.select("p_partkey", F.round(sequences.similarity(F.col("s"), F.lit("antique steel")), 6).alias("similarity"))


@registry.query()
def fuzzy_word_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The words of all documents that are like a word of the benchmark by 0.84, found in one join."""
    words = lambda name: table(spark, sf, name).select(F.explode(T.tokens(F.coalesce("text", F.lit("")), 3)).alias("word"))
    found = sequences.similar_pairs(words("benchmark").withColumnRenamed("word", "term"), words("documents"))
    return found.select("term", "word", F.round("score", 6).alias("score"))


CONCEPTS = (("the", 1), ("and the", 2), ("tion", 2), ("ing", 3), ("vacation pay", 3), ("thewh", 4))


@registry.query(f"""WITH c(concept, article) AS (VALUES {", ".join(map(str, CONCEPTS))}), d AS (SELECT doc_id, lower(text) AS low, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, article, CASE WHEN contains(low, concept) THEN 3 WHEN list_contains(words, concept) THEN 2 WHEN len(list_filter(words, lambda w: contains(concept, w) OR contains(w, concept))) > 0 THEN 1 ELSE 0 END AS p FROM d, c)
SELECT doc_id, article, CAST(sum(p) AS BIGINT) AS points FROM s WHERE p > 0 GROUP BY doc_id, article""")
def concept_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Points of each article whose concepts a text names: 3 within the text, 2 as a word, 1 in part either way. The concepts are an array of literals."""
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.lower("text").alias("low"))
    d = d.withColumn("words", F.array_distinct(F.filter(F.split("low", r"\s+"), lambda w: w != "")))
    part = lambda c: F.exists("words", lambda w: F.lit(c).contains(w) | w.contains(c))
    points = lambda c: F.when(F.col("low").contains(c), 3).when(F.array_contains("words", c), 2).when(part(c), 1).otherwise(0)
    hits = F.array(*[F.struct(F.lit(a).alias("article"), points(c).alias("p")) for c, a in CONCEPTS])
    each = d.select("doc_id", F.explode(F.filter(hits, lambda h: h["p"] > 0)).alias("h"))
    return each.groupBy("doc_id", F.col("h.article").alias("article")).agg(F.sum("h.p").alias("points"))


@registry.query("""WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations)
SELECT conv_id, turn, role, n AS n_chars FROM t WHERE r <= 3""")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))
    return windows.top_per_key(c, ["conv_id"], [F.desc("turn"), F.col("role")], 3)


@registry.query(f"WITH {TOK}, t AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) SELECT term, doc_id, count(*) AS tf, len FROM t GROUP BY term, doc_id, len")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The stored form of the keyword index."""
    return search.postings(table(spark, sf, "documents"), "text")


@registry.query(f"WITH {_bm25_sql(True)} SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from the stored index: only the terms' buckets are read, and only blocks that may hold one of the first ten."""
    return postings.stored(table(spark, sf, "documents")).topk(TERMS, 10)


@registry.query(f"WITH {_bm25_sql(False).replace('WITH ', '')} SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25")
def bm25_indexed_binary_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that count a term once a document, from the same index."""
    return postings.stored(table(spark, sf, "documents")).topk(TERMS, 25, tf_mode="binary")


@registry.query(f"WITH {TOK}, t AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM tok) SELECT term, count(*) AS df FROM t GROUP BY term")
def bm25_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary of the stored index: each term's number of documents."""
    return postings.stored(table(spark, sf, "documents")).table("terms").select("term", "df")


def _hybrid_sql(w1: float, w2: float, after: str = "", boost: str = "0") -> str:
    return f"""WITH {_bm25_sql(False)}, d AS (SELECT d.doc_id, d.lang, d.n_chars, coalesce(d.text, '') AS text, v.label, v.score FROM documents d JOIN {_cos_sql()} v ON v.vec_id = d.doc_id),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM d WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 20) {after}),
k AS (SELECT bm.doc_id, bm.score, d.lang FROM bm JOIN d USING (doc_id) WHERE bm.score > 0 ORDER BY bm.score DESC, bm.doc_id LIMIT 20),
b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM k {after}),
f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.r, 999) AS dense_rank, coalesce(b.r, 999) AS keyword_rank, coalesce({w1}::DOUBLE / (60 + a.r), 0) + coalesce({w2}::DOUBLE / (60 + b.r), 0) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT f.doc_id, dense_rank, keyword_rank, round(rrf + {boost}, 8) AS score FROM f JOIN d USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""


def _hybrid(spark: SparkSession, sf: str, w1: float, w2: float, after: Column | None = None, boost: Column | None = None) -> DataFrame:
    """Both arms over one corpus of texts with vectors, twice the wanted rows from each, then filters, fusion and boosts."""
    vectors = _scored(spark, sf).select(F.col("vec_id").alias("doc_id"), "label", F.col("score").alias("cosine"))
    docs = table(spark, sf, "documents").join(vectors, "doc_id")
    # BM25's statistics are those of the whole corpus, as its index would hold them.
    keyword = search.bm25(table(spark, sf, "documents"), "text", TERMS, keep=("doc_id", "lang")).join(vectors.select("doc_id"), "doc_id", "left_semi")
    return search.hybrid(docs, keyword, "doc_id", "cosine", (w1, w2), 10, after, boost)


@registry.query(_hybrid_sql(1.0, 0.5))
def hybrid_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, 1.0, 0.5)


@registry.query(_hybrid_sql(1.0, 0.5, "WHERE lang = 'en'"))
def hybrid_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The filter comes after the arms' tops, so that fewer rows than wanted may be left."""
    return _hybrid(spark, sf, 1.0, 0.5, after=F.col("lang") == "en")


@registry.query(_hybrid_sql(1.0, 0.5, "", "CASE WHEN label IN (1, 3) THEN 0.08::DOUBLE ELSE -0.01::DOUBLE END + CASE WHEN n_chars > 2000 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'tion') THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(substr(lower(text), 1, 800), '[$]|effective|after ') THEN 0.02::DOUBLE ELSE 0 END"))
def hybrid_article_and_table_boosts(spark: SparkSession, sf: str) -> DataFrame:
    """Boosts of preferred articles and of rows that hold tables, appendices or amounts, on the fused score."""
    low = F.lower(F.coalesce("text", F.lit("")))
    boost = search.article_boost(F.col("label").isin(1, 3)) + search.table_boost(F.col("n_chars") > 2000, low.contains("tion"), low)
    return _hybrid(spark, sf, 1.0, 0.5, boost=boost)


LETTER_TERMS = ["thing", "ation", "inter"]


@registry.query(_hybrid_sql(1.0, 0.5, "", "CASE WHEN label = 2 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN contains(lower(substr(text, 1, 1200)), 'the ') THEN 0.01::DOUBLE ELSE 0 END + least(0.08::DOUBLE, 0.02::DOUBLE * (" + " + ".join(f"CAST(contains(lower(substr(text, 1, 1200)), '{t}') AS INTEGER)" for t in LETTER_TERMS) + ")) + CASE WHEN contains(lower(substr(text, 1, 1200)), 'ing') THEN 0.05::DOUBLE ELSE 0 END"))
def hybrid_letter_boosts(spark: SparkSession, sf: str) -> DataFrame:
    """Boosts of side letters for a follow-up question: their type, their phrases, the question's words, the cues of a follow-up."""
    blob = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 1200))
    boost = search.letter_boost(F.col("label") == 2, blob.contains("the "), [blob.contains(t) for t in LETTER_TERMS], blob.contains("ing"), "followup")
    return _hybrid(spark, sf, 1.0, 0.5, boost=boost)


@registry.query(f"""SELECT vec_id, label, round(score + CASE WHEN label = 3 THEN 0.3 ELSE 0 END + CASE WHEN vec_id % 9 = 4 THEN 0.1 ELSE 0 END + CASE WHEN label IN (1, 2) THEN 0.2 ELSE 0 END
+ CASE WHEN vec_id % 2 = 0 THEN 0.15 WHEN vec_id % 5 <> 0 THEN -0.05 ELSE 0 END + CASE WHEN vec_id % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN vec_id % 4 = 0 THEN 0.1 ELSE 0 END, 6) AS boosted FROM {_cos_sql()} WHERE score >= 0.1 ORDER BY boosted DESC, vec_id LIMIT 15""")
def metadata_boosts_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All six boosts of dense search, then the order anew: article and section that the question names, preferred articles, class, topic, high stakes."""
    v = F.col("vec_id")
    boost = search.metadata_boost(F.col("label") == 3, v % 9 == 4, F.col("label").isin(1, 2), v % 2 == 0, v % 5 == 0, v % 3 == 0, v % 4 == 0)
    s = _scored(spark, sf).filter("score >= 0.1").select("vec_id", "label", F.round(F.col("score") + boost, 6).alias("boosted"))
    return search.top(s, "boosted", "vec_id", 15)
