"""A stored keyword index: postings by buckets of terms, in blocks of documents with their largest weights.

``build`` tokenizes a corpus once. A row of the index is a posting: a term in a document. The rows of a term in a block of documents stand
together, and the first of them holds the most that any of them can add to a score. A query reads the folders of its terms' buckets only, and of them first the weights: the blocks of
the highest bounds are scored whole, and then only those whose bound reaches the k-th score so far. Both give exactly the
rows that a scan of all texts gives.

Null texts are documents without words; rows that repeat an id are documents of their own, as in a scan; rows without an id are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.search import B, K1, top
from .artifacts import _filesystem, exists

BUCKETS, BLOCK_DOCS, SPREAD = 64, 128, 4
#: Changes with the stored tables, so that an index of an older form isn't opened.
FORM = 4
#: Scores are rounded to so many places before they are compared.
PLACES = 6
#: The stored tables, with the type of the keys left open; an empty corpus leaves no file to read a schema from.
_SCHEMAS = {
    "postings": "term string, block bigint, docs bigint, tf_most bigint, share_least double, len_least bigint, key {}, row bigint, tf bigint, len bigint, bucket int",
    "terms": "term string, df bigint, bucket int",
}


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def _counts(words: str) -> Column:
    """array<struct<term, tf>>: the distinct words of an array, each with how often it stands there."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        # The array of starts is held as the one element of an array, so that it's made once a text and not once a word.
        tell = lambda s: F.transform(s, lambda at, k: F.struct(F.get(w, at).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w)) - at).cast("bigint").alias("tf")))
        return F.transform(F.array(starts), tell)[0]

    return F.when(F.size(words) > 0, F.transform(F.array(F.sort_array(words)), runs)[0])


def build(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> None:
    """Writes the index of a corpus to a folder that must not exist; a job that fails leaves none behind under that name."""
    spark = docs.sparkSession
    making = f"{path}-{uuid.uuid4().hex}"
    own = docs.filter(F.col(key).isNotNull())
    counted = own.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), tokens(F.coalesce(text, F.lit(""))).alias("_t")).withColumn("len", F.size("_t").cast("bigint"))
    n = own.count()
    blocks = max(1, -(-n // block_docs))
    # Terms are counted within their rows, so that one shuffle brings each file's rows together and serves all that follows.
    held = counted.select("key", "row", "len", F.explode(_counts("_t")).alias("_h")).select("key", "row", "len", "_h.term", "_h.tf")
    # A term of all documents fills its bucket: the bucket's rows are dealt over SPREAD files, each in the order of its terms.
    placed = held.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("bucket", _bucket(F.col("term"), buckets)).withColumn("spread", F.pmod("block", F.lit(SPREAD)))
    # Postings aren't gathered into arrays, which sorts and copies them twice: a window marks the first one of a term in a block, and
    # gives it what bounds the others' weights under any mean length, so that texts are cut into words once.
    along = Window.partitionBy("bucket", "term", "block", "spread").orderBy("row")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = lambda value: F.when(F.row_number().over(along) == 1, value.over(whole))
    rows = placed.repartition("bucket", "spread").select(
        "bucket", "term", "block", told(F.count(F.lit(1))).alias("docs"), told(F.max("tf")).alias("tf_most"), told(F.min(F.col("len") / F.col("tf"))).alias("share_least"),
        told(F.min("len")).alias("len_least"), "key", "row", "tf", "len",
    )
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{making}/postings")
    kind = rows.schema["key"].dataType.simpleString()
    stored = spark.read.schema(_SCHEMAS["postings"].format(kind)).parquet(f"{making}/postings")
    stored.filter("docs IS NOT NULL").groupBy("bucket", "term").agg(F.sum("docs").alias("df")).repartition("bucket").write.partitionBy("bucket").parquet(f"{making}/terms")
    mean = (stored.agg(F.sum("tf")).first()[0] or n or 1) / (n or 1)
    spark.createDataFrame([(n, float(mean), blocks, buckets, kind)], "n bigint, mean double, blocks bigint, buckets int, kind string").write.parquet(f"{making}/stats")
    fs, where = _filesystem(spark, making)
    target = _filesystem(spark, path)[1]
    if fs.exists(target) or not fs.rename(where, target):
        fs.delete(where, True)
        if not fs.exists(target):
            raise OSError(f"the index couldn't be put to {path}")


@dataclass
class PostingIndex:
    """An index that ``build`` has written."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.n, self.mean, self.blocks, self.buckets, self.kind = self.spark.read.parquet(f"{self.path}/stats").first()

    def table(self, name: str) -> DataFrame:
        """'postings' or 'terms' as they are stored."""
        return self.spark.read.schema(_SCHEMAS[name].format(self.kind)).parquet(f"{self.path}/{name}")

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms; other buckets' folders aren't opened."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets).alias("b"))
        return self.table(name).filter(F.col("bucket").isin(*{r.b for r in asked.collect()}) & F.col("term").isin(*terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many documents hold each term; a row a term comes to the driver."""
        return {r.term: r.df for r in self._of("terms", terms).select("term", "df").collect()} if terms else {}

    def topk(self, terms: list[str], k: int, tf_mode: str = "count", seeds: int | None = None, key: str = "doc_id") -> DataFrame:
        """(key, score) of the k best documents, ties by key. A repeated term counts again; 'binary' counts a term once a document."""
        return self.search(terms, k, tf_mode, seeds, key)[0]

    def search(self, terms: list[str], k: int, tf_mode: str = "count", seeds: int | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
        """The k best documents, and (block) the blocks whose postings were read for them."""
        distinct = list(dict.fromkeys(terms))
        df_of = self.frequencies(distinct)
        known = [t for t in distinct if t in df_of]
        if not known:
            return self.spark.createDataFrame([], f"{key} {self.kind}, score double"), None
        gain = F.create_map(*[x for t in known for x in (F.lit(t), F.lit(float(terms.count(t))) * F.log((F.lit(self.n) - df_of[t] + 0.5) / (F.lit(df_of[t]) + 0.5) + 1.0))])
        rows = self._of("postings", known)
        # No posting's tf is larger, nor its length a term, so that no weight is; where a term counts once, the shortest text has the largest.
        most = _weight(F.lit(1.0), F.col("len_least"), self.mean) if tf_mode == "binary" else (K1 + 1) / (1 + K1 * ((1 - B) / F.col("tf_most") + B * F.col("share_least") / self.mean))
        bounds = rows.filter("docs IS NOT NULL").groupBy("block").agg(F.sum(gain[F.col("term")] * most).alias("bound"))

        def scored(some: DataFrame) -> DataFrame:
            tf = F.col("tf").cast("double") if tf_mode == "count" else F.lit(1.0)
            score = F.round(F.sum(gain[F.col("term")] * _weight(tf, F.col("len"), self.mean)), PLACES)
            return some.groupBy(F.col("key").alias(key), "row").agg(score.alias("score")).select(key, "score").filter("score > 0")

        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(seeds or max(2, k)).collect()]
        best = top(scored(rows.filter(F.col("block").isin(*first))), "score", key, k).collect()
        least = best[-1].score - 10.0**-PLACES if len(best) == k else 0.0
        reach = bounds.filter((F.col("bound") >= least) & ~F.col("block").isin(*first)).select("block")
        rest = scored(rows.join(reach, "block", "left_semi"))
        found = self.spark.createDataFrame([(r[key], r.score) for r in best], rest.schema)
        read = reach.unionByName(self.spark.createDataFrame([(b,) for b in first], "block bigint"))
        return top(rest.unionByName(found), "score", key, k), read


def _root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def signature(docs: DataFrame, *parameters: object) -> str:
    """Names the state of a corpus' files: their paths, lengths and times of change."""
    files = []
    for path in sorted(docs.inputFiles()):
        fs, where = _filesystem(docs.sparkSession, path)
        status = fs.getFileStatus(where)
        files.append((path, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(repr((files, parameters)).encode()).hexdigest()[:24]


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id", root: str | None = None, **parameters) -> PostingIndex:
    """The index of a corpus of files, built on the first call and as often as a file changes."""
    spark = docs.sparkSession
    path = f"{root or _root(spark)}/brindle-postings-{signature(docs, FORM, text, key, sorted(parameters.items()))}"
    if not exists(spark, f"{path}/stats/_SUCCESS"):
        build(docs, path, text, key, **parameters)
    return PostingIndex(spark, path)
