"""Versions of customers' contracts from their orders: trees, rows in force, merges, rebased patches and chains of patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import version_tree as V
from ..sources.tables import checkpointed, table
from .registry import Registry

registry = Registry()


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a version; its parent is the order before it, for every third one that before that: side branches."""
    o = V.together(table(spark, sf, "orders").select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))
    w = Window.partitionBy("contract").orderBy("day", "version")
    back = F.lag("version", 2).over(w)
    return o.withColumn("before", F.lag("version").over(w)).withColumn("parent", F.when((F.col("version") % 3 == 0) & back.isNotNull(), back).otherwise(F.col("before")))


def _changes(spark: SparkSession, sf: str, owners: DataFrame | None = None) -> DataFrame:
    """An order's lines change the targets of their numbers; each thirteenth part takes its target away.

    ``owners``: contract and version of the changes asked for, and more columns to go with them; all orders without.
    """
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").cast("bigint").alias("target"), "l_partkey")
    li = V.together(lines, "version").groupBy("version", "target").agg(F.min("l_partkey").alias("part"))
    value = F.when(F.col("part") % 13 != 0, F.col("part"))
    if owners is None:
        owners = table(spark, sf, "orders").select(F.col("o_custkey").alias("contract"), F.col("o_orderkey").alias("version"))
    more = [c for c in owners.columns if c not in ("contract", "version")]
    return li.join(V.together(owners, "version"), "version").select("contract", "version", "target", value.alias("value"), *more)


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """Seven targets of every customer."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("contract"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("target"))
    return c.withColumn("value", -(F.col("contract") * 10 + F.col("target")))


VERSIONS = """o AS (SELECT o_custkey AS contract, o_orderkey AS version, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
v AS (SELECT contract, version, day, before, CASE WHEN version % 3 = 0 AND back IS NOT NULL THEN back ELSE before END AS parent FROM (SELECT *, lag(version) OVER w AS before, lag(version, 2) OVER w AS back FROM o WINDOW w AS (PARTITION BY contract ORDER BY day, version))),
ch AS (SELECT contract, version, CAST(target AS BIGINT) AS target, CASE WHEN part % 13 <> 0 THEN part END AS value FROM (SELECT l_orderkey AS version, l_linenumber AS target, min(l_partkey) AS part FROM lineitem GROUP BY ALL) JOIN o USING (version)),
b AS (SELECT c_custkey AS contract, t.range AS target, -(c_custkey * 10 + t.range) AS value FROM customer, range(1, 8) t),
anc AS (SELECT contract, version, version AS ancestor, 0 AS distance FROM v UNION ALL SELECT anc.contract, anc.version, v.parent, distance + 1 FROM anc JOIN v ON v.version = anc.ancestor WHERE v.parent IS NOT NULL),
n AS (SELECT anc.contract, anc.version, target, arg_min({'f': ancestor, 'v': value}, distance) AS c FROM anc JOIN ch ON ch.version = anc.ancestor GROUP BY ALL),
f AS (SELECT v.contract, v.version, t.range AS target FROM v, range(1, 8) t),
e AS (SELECT contract, version, target, CASE WHEN n.c IS NOT NULL THEN n.c.v ELSE b.value END AS value, n.c.f AS from_version FROM f LEFT JOIN n USING (contract, version, target) LEFT JOIN b USING (contract, target)),
inforce AS (SELECT * FROM e WHERE value IS NOT NULL)"""


@registry.query(f"WITH RECURSIVE {VERSIONS} SELECT contract, version, CAST(count(*) - 1 AS BIGINT) AS ancestors, min(ancestor) AS least FROM anc GROUP BY contract, version")
def version_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    a = V.ancestry(_versions(spark, sf))
    return a.groupBy("contract", "version").agg((F.count(F.lit(1)) - 1).alias("ancestors"), F.min("ancestor").alias("least"))


@registry.query(f"WITH RECURSIVE {VERSIONS} SELECT contract, version, target, value, from_version FROM inforce")
def version_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What is in force at every version of every contract."""
    return V.rows_at(V.ancestry(_versions(spark, sf)), _changes(spark, sf), _base(spark, sf))


@registry.query(f"""WITH RECURSIVE {VERSIONS}, p AS (SELECT contract, version AS ours, before AS theirs FROM v WHERE parent IS DISTINCT FROM before),
m AS (SELECT p.*, (SELECT arg_min(x.ancestor, (x.distance + y.distance, x.ancestor)) FROM anc x JOIN anc y ON y.ancestor = x.ancestor WHERE x.version = p.ours AND y.version = p.theirs) AS fork FROM p),
k AS (SELECT m.*, t.range AS target FROM m, range(1, 8) t),
j AS (SELECT k.*, i.value AS o, h.value AS t, g.value AS g FROM k LEFT JOIN inforce i ON i.version = ours AND i.target = k.target LEFT JOIN inforce h ON h.version = theirs AND h.target = k.target LEFT JOIN inforce g ON g.version = fork AND g.target = k.target),
s AS (SELECT *, CASE WHEN o IS NOT DISTINCT FROM g AND t IS NOT DISTINCT FROM g THEN 'same' WHEN t IS NOT DISTINCT FROM g THEN 'ours' WHEN o IS NOT DISTINCT FROM g THEN 'theirs' WHEN o IS NOT DISTINCT FROM t THEN 'both' ELSE 'conflict' END AS state FROM j WHERE o IS NOT NULL OR t IS NOT NULL OR g IS NOT NULL)
SELECT contract, ours AS version, theirs AS other, fork, target, state, CASE state WHEN 'theirs' THEN t WHEN 'conflict' THEN NULL ELSE o END AS value FROM s""")
def version_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Side branches merged with the version that came before them: rows by who changed them since the fork, with conflicts named."""
    v = _versions(spark, sf)
    ancestors = V.ancestry(v)
    rows = V.rows_at(ancestors, _changes(spark, sf), _base(spark, sf)).select("contract", F.col("version").alias("_v"), "target", "value")
    pairs = V.common_ancestors(ancestors, v.filter(~F.col("parent").eqNullSafe(F.col("before"))).select("contract", F.col("version").alias("ours"), F.col("before").alias("theirs")))
    keys = ["contract", "ours", "theirs", "fork", "target"]
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(which).alias("_v")) for i, which in enumerate(("fork", "ours", "theirs"))]))
    asked = pairs.select("contract", "ours", "theirs", "fork", sides.alias("_s")).select("contract", "ours", "theirs", "fork", "_s.*")
    merged = V.merged_sides(asked.join(rows, ["contract", "_v"]), keys)
    return merged.select("contract", F.col("ours").alias("version"), F.col("theirs").alias("other"), "fork", "target", "state", "value")


@registry.query(f"""WITH RECURSIVE {VERSIONS}, last AS (SELECT contract, arg_max(version, (day, version)) AS version FROM v GROUP BY contract), now_ AS (SELECT i.* FROM inforce i JOIN last USING (contract, version)),
ops AS (SELECT c_custkey AS contract, c_custkey * 10 + t.range % 2 AS patch_id, t.range AS op_no, CASE WHEN c_custkey % 17 = 0 AND t.range = 4 THEN 99 ELSE t.range * 2 - 1 END AS target, sha256(CAST(-(c_custkey * 10 + t.range * 2 - 1) AS VARCHAR)) AS expected FROM customer, range(1, 5) t WHERE c_custkey IN (SELECT contract FROM last)),
j AS (SELECT ops.*, n.value, n.from_version AS last_touch, CASE WHEN n.target IS NULL THEN 'target_not_found' END AS error FROM ops LEFT JOIN now_ n USING (contract, target)), s AS (SELECT contract, patch_id, CASE WHEN count(error) > 0 THEN 'failed' ELSE 'success' END AS status FROM j GROUP BY ALL)
SELECT contract, patch_id, op_no, target, CASE WHEN status = 'success' THEN sha256(CAST(value AS VARCHAR)) ELSE expected END AS new_expected, CASE WHEN error IS NULL THEN CAST(sha256(CAST(value AS VARCHAR)) <> expected AS INTEGER) END AS changed, last_touch, error, status FROM j JOIN s USING (contract, patch_id)""")
def patch_rebase(spark: SparkSession, sf: str) -> DataFrame:
    """Patches written for the base, made fit for the last version: hashes in force, who touched a row last, targets that are gone."""
    v = _versions(spark, sf)
    last = checkpointed(v.groupBy("contract").agg(F.max_by("version", F.struct("day", "version")).alias("version")))
    line = V.lineage(v, last).select("contract", F.col("ancestor").alias("version"), "distance")
    rows = V.rows_along(_changes(spark, sf, line).withColumnRenamed("version", "ancestor"), _base(spark, sf))
    k, n = F.col("contract"), F.col("op_no")
    ops = last.select("contract", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("op_no")).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("contract")), "contract")
    ops = ops.select("contract", (k * 10 + n % 2).alias("patch_id"), "op_no", F.when((k % 17 == 0) & (n == 4), 99).otherwise(n * 2 - 1).alias("target"), F.sha2((-(k * 10 + n * 2 - 1)).cast("string"), 256).alias("expected"))
    done = V.rebase(ops, rows, F.sha2(F.col("value").cast("string"), 256))
    return done.withColumn("changed", F.col("changed").cast("int")).drop("expected")


@registry.query("""WITH RECURSIVE x AS (SELECT o_custkey AS contract, strftime(o_orderdate, '%Y-%m-%d') AS effective_date, o_orderkey AS patch_id, l_linenumber AS op_no, min(l_partkey) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT contract, effective_date, patch_id, count(*) AS operations, count(*) FILTER (part % 11 <> 0) AS approved, sha256(string_agg(op_no || ':' || part, chr(10) ORDER BY op_no)) AS payload_sha256 FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY effective_date, patch_id) AS place FROM p),
c AS (SELECT r.*, sha256(payload_sha256) AS chain_sha256 FROM r WHERE place = 1 UNION ALL SELECT r.*, sha256(c.chain_sha256 || r.payload_sha256) FROM c JOIN r ON r.contract = c.contract AND r.place = c.place + 1)
SELECT contract, place, patch_id, effective_date, operations, approved, payload_sha256, chain_sha256 FROM c""")
def patch_chain_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of patches of each contract: each link is the digest of the one before and of the patch."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("contract"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"), F.col("o_orderkey").alias("patch_id"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("patch_id"), F.col("l_linenumber").alias("op_no")).agg(F.min("l_partkey").alias("part"))
    ops = o.join(li, "patch_id").withColumn("approved", F.col("part") % 11 != 0)
    return V.patch_chain(ops, F.concat_ws(":", "op_no", "part"))
