"""Trees of versions: ancestors, rows in force at each version, common ancestors, three-way merges; rebased patches and chains.

``versions``: contract, version, parent (null for a first version). ``changes``: contract, version, target, value; a null value takes
the target away. ``base``: contract, target, value of what stands before all versions.

Defined results: a parent that isn't a version of the contract counts as none, and the walk ends there; versions that are their own
ancestors are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

#: Doublings of the way to an ancestor; a tree is at most 2 ** 30 versions deep.
MOST_DOUBLINGS = 30


def ancestry(versions: DataFrame) -> DataFrame:
    """(contract, version, ancestor, distance): each version's ancestors, itself at distance 0, by doubling the way walked.

    After k rounds all ancestors nearer than 2 ** k are known; the next round joins each of them to its own.
    """
    steps = _steps(versions).withColumn("distance", F.lit(1))
    # Each round stores what it adds and nothing else.
    last = checkpointed(versions.select("contract", "version", F.col("version").alias("ancestor"), F.lit(0).alias("distance")).unionByName(steps))
    reach = last
    for k in range(MOST_DOUBLINGS):
        far = last.filter(F.col("distance") == 1 << k)
        if far.isEmpty():
            return reach
        on = reach.filter(F.col("distance") > 0).select("contract", F.col("version").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        last = checkpointed(far.join(on, ["contract", "ancestor"]).select("contract", "version", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")))
        if not last.filter("version = ancestor").isEmpty():
            raise ValueError("a version is its own ancestor")
        reach = reach.unionByName(last)
    raise ValueError("a version is its own ancestor")


def _steps(versions: DataFrame) -> DataFrame:
    """(contract, version, ancestor): each version's parent, where it is a version."""
    known = versions.select("contract", F.col("version").alias("parent"))
    steps = versions.filter("parent IS NOT NULL").select("contract", "version", "parent").join(known, ["contract", "parent"], "left_semi")
    return steps.select("contract", "version", F.col("parent").alias("ancestor"))


def lineage(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(contract, version, ancestor, distance) as ``ancestry`` has it, of the versions asked for alone (contract, version).

    A round doubles the length of all versions' leaps, a row each, and takes what is known of the asked ones by a leap further: no more
    rows than versions are stored in a round, while all ancestors of all versions are as many as their depths add up to.
    """
    leaps = checkpointed(_steps(versions))
    reach = asked.select("contract", "version", F.col("version").alias("ancestor"), F.lit(0).alias("distance"))
    most = leaps.groupBy("contract").count().agg(F.max("count")).first()[0] or 0
    for k in range(MOST_DOUBLINGS):
        if leaps.isEmpty():
            return reach
        if most < 1 << k:  # a way of as many steps leaves as many versions
            break
        further = leaps.select("contract", F.col("version").alias("ancestor"), F.col("ancestor").alias("further"))
        told = lambda df, *more: df.join(further, ["contract", "ancestor"]).select("contract", "version", F.col("further").alias("ancestor"), *more)  # noqa: B023, E731
        reach = reach.unionByName(checkpointed(told(reach, (F.col("distance") + (1 << k)).alias("distance"))))
        leaps = checkpointed(told(leaps))
    raise ValueError("a version is its own ancestor")


def together(df: DataFrame, by: str = "contract") -> DataFrame:
    """The rows of a contract in one partition of a set number, so that joins and groups by a contract and more move nothing again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def rows_at(ancestors: DataFrame, changes: DataFrame, base: DataFrame) -> DataFrame:
    """(contract, version, target, value, from_version): what is in force at each version, and the version that it comes from.

    ``ancestors``: of all versions or of those asked for. The nearest ancestor that names a target decides; from_version is null where
    the base does, which is farther than all of them. Targets that are taken away are left out.
    """
    # The base counts as the farthest ancestor of every version. Ancestors and changes lie together by contracts; a window hands each
    # ancestor's changes to its versions, so that what this multiplies is grouped where it is.
    kind, no = ancestors.schema["ancestor"].dataType, F.lit(None)
    reach = ancestors.select("contract", "version", "ancestor", "distance", F.lit(False).alias("_base"), no.cast(changes.schema["target"].dataType).alias("target"), no.cast(changes.schema["value"].dataType).alias("value"))
    farthest = reach.filter("distance = 0").select("contract", "version", no.cast(kind).alias("ancestor"), F.lit((1 << 31) - 1).alias("distance"), F.lit(True).alias("_base"), "target", "value")
    held = lambda df, ancestor, is_base: df.select("contract", no.cast(kind).alias("version"), ancestor.alias("ancestor"), no.cast("int").alias("distance"), F.lit(is_base).alias("_base"), "target", "value")
    every = together(reach.unionByName(farthest).unionByName(held(changes, F.col("version"), False)).unionByName(held(base, no.cast(kind), True)))
    named = F.collect_list(F.when(F.col("distance").isNull(), F.struct("target", "value"))).over(Window.partitionBy("contract", "ancestor", "_base"))
    told = every.withColumn("_named", named).filter("distance IS NOT NULL").select("contract", "version", "ancestor", "distance", F.explode("_named").alias("_n"))
    return _nearest(told.select("contract", "version", "ancestor", "distance", "_n.*"), ["contract", "version", "target"])


def rows_along(told: DataFrame, base: DataFrame) -> DataFrame:
    """(contract, target, value, from_version): as ``rows_at``, for one version of each contract and the base's other contracts.

    ``told``: contract, ancestor, distance, target, value: the version's ancestors with what they change.
    """
    no = F.lit(None).cast(told.schema["ancestor"].dataType)
    farthest = base.select("contract", no.alias("ancestor"), F.lit((1 << 31) - 1).alias("distance"), "target", "value")
    return _nearest(together(told.select(farthest.columns).unionByName(farthest)), ["contract", "target"])


def _nearest(told: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, from_version of the nearest ancestor; without those that are taken away."""
    near = told.groupBy(*keys).agg(F.min_by(F.struct(F.col("ancestor").alias("from_version"), F.col("value").alias("value")), "distance").alias("_c"))
    return near.select(*keys, "_c.value", "_c.from_version").filter("value IS NOT NULL")


def common_ancestors(ancestors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(contract, ours, theirs, fork) of pairs (contract, ours, theirs): their nearest common ancestor, null where they have none."""
    ancestors = together(ancestors)
    a = ancestors.select("contract", F.col("version").alias("ours"), F.col("ancestor").alias("fork"), F.col("distance").alias("_a"))
    b = ancestors.select("contract", F.col("version").alias("theirs"), F.col("ancestor").alias("fork"), F.col("distance").alias("_b"))
    met = pairs.join(a, ["contract", "ours"]).join(b, ["contract", "theirs", "fork"])
    near = met.groupBy("contract", "ours", "theirs").agg(F.min_by("fork", F.struct(F.col("_a") + F.col("_b"), F.col("fork"))).alias("fork"))
    return pairs.join(near, ["contract", "ours", "theirs"], "left")


def three_way(fork: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, state, our_value, their_value: rows of two versions merged by what they changed since their fork.

    ``state``: 'same' where neither changed it, 'ours', 'theirs', 'both' where both made the same change, 'conflict' where
    they differ: then the value is null. A row that is missing counts as a null value. Each side: keys, value.
    """
    side = lambda df, i: df.select(*keys, F.lit(i).alias("side"), "value")
    return merged_sides(side(fork, 0).unionByName(side(ours, 1)).unionByName(side(theirs, 2)), keys)


def merged_sides(every: DataFrame, keys: list[str]) -> DataFrame:
    """As ``three_way``, of keys, side (0 the fork, 1 ours, 2 theirs), value: a side has a key once at most."""
    all_ = every.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == i, F.col("value"))).alias(name) for i, name in enumerate(("_fork", "our_value", "their_value"))])
    eq = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = (
        F.when(eq("our_value", "_fork") & eq("their_value", "_fork"), "same").when(eq("their_value", "_fork"), "ours").when(eq("our_value", "_fork"), "theirs")
        .when(eq("our_value", "their_value"), "both").otherwise("conflict")
    )
    told = all_.withColumn("state", state)
    value = F.when(F.col("state").isin("same", "ours", "both"), F.col("our_value")).when(F.col("state") == "theirs", F.col("their_value"))
    return told.select(*keys, value.alias("value"), "state", "our_value", "their_value")


def rebase(ops: DataFrame, rows: DataFrame, value_hash: Column) -> DataFrame:
    """The operations of patches made fit for the rows that are in force now.

    ``ops``: contract, patch_id, op_no, target, expected. ``rows``: contract, target, value, from_version; ``value_hash`` is an
    expression over them. Adds new_expected (the hash in force), changed, last_touch (the version that put the row there), error where the
    target is gone, and status: a patch with an error fails as a whole, and then keeps what it expected.
    """
    held = rows.select("contract", "target", value_hash.alias("_hash"), F.col("from_version").alias("last_touch"), F.lit(True).alias("_there"))
    told = ops.join(held, ["contract", "target"], "left").withColumn("error", F.when(F.col("_there").isNull(), "target_not_found"))
    failed = told.groupBy("contract", "patch_id").agg(F.when(F.count("error") > 0, "failed").otherwise("success").alias("status"))
    told = told.join(failed, ["contract", "patch_id"])
    new = F.when(F.col("status") == "success", F.col("_hash")).otherwise(F.col("expected"))
    same = F.lower(F.trim(F.coalesce("expected", F.lit("")))) == F.col("_hash")
    return told.select(*ops.columns, new.alias("new_expected"), F.when(F.col("error").isNull(), ~same).alias("changed"), "last_touch", "error", "status")


def patch_chain(ops: DataFrame, payload: Column) -> DataFrame:
    """(contract, place, patch_id, effective_date, operations, approved, payload_sha256, chain_sha256): the patches of each contract in the order of their chain.

    ``ops``: contract, effective_date, patch_id, op_no, approved, all of one applied chain; ``payload`` is a text of an operation. A patch's
    digest is that of its operations in order; each link of the chain is the digest of the one before and of the patch, so that
    any change shows in all links behind it. What is folded are a contract's patches, one digest each.
    """
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_no", payload.alias("p")))), lambda x: x["p"]), "\n")
    each = ops.groupBy("contract", "effective_date", "patch_id").agg(F.count(F.lit(1)).alias("operations"), F.count_if("approved").alias("approved"), F.sha2(lines, 256).alias("payload_sha256"))
    row = F.struct("effective_date", "patch_id", "operations", "approved", "payload_sha256")
    held = each.groupBy("contract").agg(F.array_sort(F.collect_list(row)).alias("_all"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("links"))

    def step(state: Column, x: Column) -> Column:
        link = F.sha2(F.concat(state["last"], x["payload_sha256"]), 256)
        return F.struct(link.alias("last"), F.concat(state["links"], F.array(link)).alias("links"))

    held = held.withColumn("_links", F.aggregate("_all", start, step, lambda s: s["links"]))
    out = held.select("contract", F.posexplode(F.arrays_zip(F.col("_all").alias("p"), F.col("_links").alias("c"))).alias("place", "_x"))
    return out.select("contract", (F.col("place") + 1).cast("bigint").alias("place"), "_x.p.patch_id", "_x.p.effective_date", "_x.p.operations", "_x.p.approved", "_x.p.payload_sha256", F.col("_x.c").alias("chain_sha256"))
