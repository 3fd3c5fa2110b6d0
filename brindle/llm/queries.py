"""One query per operator, with production parameters over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, fingerprints, html, jaccard, merkle, packing, pivots, quality_rules, secrets, sharding, suffix, variants
from .common import Scratch

SHARD_NAMES = [f"shard-{i:02d}" for i in range(sharding.SHARDS)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("text_chars"))
    return sharding.shard(docs, "doc_id", SHARD_NAMES).select("doc_id", "slot", "shard", "text_chars")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.find_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def tokenizer_path() -> str:
    """The place of the vocabulary; every executor has it installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = _table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    back = coded.withColumn("decoded", bpe.decode(F.col("ids"), path))
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", secrets.scan(F.col("text")).alias("found"))
    of = lambda kind: F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) AS bigint)")
    base = "filter(found, s -> s.kind IN ({}))".format(", ".join(f"'{k}'" for k in secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(F.expr(_listed(base)), 256).alias("base_sha256"),
        F.expr(_listed("found")).alias("spans"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row by hash is tampered with: its text loses its upper case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(_table(spark, sf_dir, "documents"), Scratch(spark), tampered=tampered, altered={"text": F.translate("text", upper, upper.lower())})


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT doc_id, body,
    list_filter(regexp_split_to_array(body, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(body, chr(10)), lambda x: length(regexp_replace(x, '[ \t\n\x0B\f\r]', '', 'g')) > 0) AS lines
  FROM t
),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
again AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT win.doc_id, win.i + k.k AS p FROM win JOIN again USING (doc_id, s) CROSS JOIN (VALUES (0), (1), (2)) AS k(k)
  ) GROUP BY doc_id
),
f AS (
  SELECT w.doc_id, words, len(words) AS n_words, len(lines) AS n_lines,
    length(regexp_replace(body, '[ \t\n\x0B\f\r]+', '', 'g')) AS word_chars,
    length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
    AND word_chars BETWEEN 2 * n_words AND 20 * n_words
    AND 2 * len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) <= n_words
    AND 4 * len(list_filter(words, lambda x: contains(x, '!!') OR contains(x, '??'))) <= n_words
    AND 2 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) >= n_words
    AND 20 * len(list_distinct(words)) >= least(n_words, 400) AS kept
FROM b
"""

OP3_SQL = f"""
WITH t AS (SELECT string_split('{",".join(map(str, sharding.fill_table(SHARD_NAMES)))}', ',') AS owner),
d AS (
  SELECT doc_id, length(text) AS n,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot
  FROM documents
)
SELECT doc_id, slot, CAST(owner[slot + 1] AS BIGINT) AS shard, CAST(n AS BIGINT) AS text_chars FROM d, t
"""


#: CRC-32 by its table of 256 values, which its polynomial gives.
CRC_TABLE = """
crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
  FROM range(256) t(i)
)"""


def _crc32_sql(text: str) -> str:
    code = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    return f"xor(list_reduce({code}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


#: Near words share what is left when one code point is masked, or one is masked and the other has none there.
OP12_SQL = f"""
WITH {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]{{6,}}')) AS run FROM documents) GROUP BY ALL
),
hashed AS (SELECT run, n, {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, l, r) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON b.word = a.l || a.r
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON b.word = a.l || a.r
),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
),
walk AS (
  SELECT word, word AS root FROM told
  UNION SELECT walk.word, told.form FROM walk JOIN told ON told.word = walk.root WHERE told.form IS NOT NULL
)
SELECT t.word, t.n, CAST(t.n_near AS BIGINT) AS n_near, t.form, t.form_n, w.root
FROM told t JOIN walk w USING (word) JOIN told e ON e.word = w.root WHERE e.form IS NULL
""".replace("WITH ", "WITH RECURSIVE ", 1)


def _op13_sql(levels: int = 7) -> str:
    """The trees level by level; ``levels`` of sixteen nodes a parent hold 16^levels rows a source and as many sources."""
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE,
        f"""
d AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(low)} END AS bad FROM documents, crc)
)""",
        "s0 AS (SELECT tree, pos, n, leaf AS node FROM d)",
    ]
    # A tree with one node left keeps it, so that all have as many levels.
    for name in ("s", "t"):
        if name == "t":
            parts.append(f"t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, node FROM s{levels})")
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}{k} GROUP BY tree, pos // 16)"
            )
    parts.append("p0 AS (SELECT doc_id, leaf, tree, pos, tree AS place, coalesce(bad, leaf) AS folded, '' AS proof FROM d)")
    count = 0
    for name in ("s", "t"):
        for k in range(levels):
            tree, pos = ("p.tree", f"p.pos // {16**k}") if name == "s" else ("0", f"p.place // {16**k}")
            side = lambda op: f"coalesce((SELECT string_agg(x.node, '' ORDER BY x.pos) FROM {name}{k} x WHERE x.tree = {tree} AND x.pos // 16 = {pos} // 16 AND x.pos {op} {pos} AND x.n > 1), '')"  # noqa: B023, E731
            parts.append(
                f"p{count + 1} AS (SELECT doc_id, leaf, tree, pos, place, proof || l || r AS proof, CASE WHEN (SELECT max(x.n) FROM {name}{k} x WHERE x.tree = c.up) = 1 THEN folded ELSE sha256(l || folded || r) END AS folded "
                f"FROM (SELECT *, {tree} AS up, {side('<')} AS l, {side('>')} AS r FROM p{count} p) c)"
            )
            count += 1
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, s{levels}.node AS subroot, t{levels}.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t{levels}.node AS verified\n"
        f"FROM p{count} JOIN s{levels} USING (tree), t{levels}"
    )


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_sharding": op3_sharding,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_bpe": op6_bpe,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_html_extraction": op10_html_extraction,
        "op11_document_fingerprints": op11_document_fingerprints,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_sharding": OP3_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
