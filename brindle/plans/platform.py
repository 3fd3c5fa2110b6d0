"""Tenant scopes, quotas, dashboards, queues, sessions and retention over events, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..sources.tables import table, tenant_scope
from .registry import Registry

registry = Registry()
NOW = "2024-01-31 00:00:00"
DAY, HOUR = "2024-01-30 00:00:00", "2024-01-30 23:00:00"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("tenant", F.col("user_id") % 10).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


EV = "e AS (SELECT *, user_id % 10 AS tenant, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@registry.query(f"WITH {EV} SELECT event_id, tenant, event_type FROM e WHERE tenant = 3")
def tenant_rls(spark: SparkSession, sf: str) -> DataFrame:
    return tenant_scope(_events(spark, sf), F.col("tenant"), 3).select("event_id", "tenant", "event_type")


@registry.query(f"WITH {EV} SELECT event_id, nullif(tenant, 0) AS tenant FROM e WHERE nullif(tenant, 0) = 3 OR nullif(tenant, 0) IS NULL")
def tenant_rls_nullable(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("tenant", F.nullif("tenant", F.lit(0)))
    return tenant_scope(e, F.col("tenant"), 3, nulls="visible").select("event_id", "tenant")


@registry.query("""WITH c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS value FROM events GROUP BY 1)
SELECT strftime(c.day, '%Y-%m-%d') AS day, coalesce(events, 0) AS events, coalesce(users, 0) AS users, coalesce(purchases, 0) AS purchases, coalesce(errors, 0) AS errors, coalesce(value, 0) AS value FROM c LEFT JOIN g USING (day)""")
def daily_dense_series(spark: SparkSession, sf: str) -> DataFrame:
    metrics = [
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("value"),
    ]
    zeros = dict.fromkeys(("events", "users", "purchases", "errors"), 0) | {"value": 0.0}
    dense = windows.dense_days(_events(spark, sf), F.to_date("ts"), "2024-01-24", 7, metrics, zeros)
    return dense.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@registry.query(f"""WITH {EV} SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT tenant) AS tenants, count(*) FILTER (event_type = 'error') AS errors,
count(*) FILTER (ts >= TIMESTAMP '{DAY}') AS last_day, count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '{DAY}') AS users_last_day, round(coalesce(sum(value), 0), 4) AS value,
round(coalesce(sum(value) FILTER (ts >= TIMESTAMP '{DAY}'), 0), 4) AS value_last_day FROM e""")
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    recent = F.col("ts") >= _ntz(DAY)
    return _events(spark, sf).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("tenant").alias("tenants"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(recent).alias("last_day"), F.count_distinct(F.when(recent, F.col("user_id"))).alias("users_last_day"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("value"), F.round(F.coalesce(F.sum(F.when(recent, F.col("value"))), F.lit(0.0)), 4).alias("value_last_day"),
    )


@registry.query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS value, max(event_id) AS last_id FROM events GROUP BY user_id, event_type")
def usage_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.max("event_id").alias("last_id"))


@registry.query(f"""WITH {EV}, g AS (SELECT tenant, count(*) FILTER (ts >= TIMESTAMP '{DAY}') / 60.0 AS r, coalesce(sum(k) FILTER (ts >= TIMESTAMP '{DAY}'), 0) / 3000.0 AS t FROM e GROUP BY tenant),
c AS (SELECT c_nationkey AS tenant, count(*) AS customers FROM customer GROUP BY 1)
SELECT n_nationkey AS tenant, coalesce(customers, 0) AS customers, round(coalesce(r, 0), 6) AS requests_ratio, round(coalesce(t, 0), 6) AS tokens_ratio,
CASE WHEN n_nationkey = 5 THEN 'paused' WHEN greatest(coalesce(r, 0), coalesce(t, 0)) >= 1 THEN 'limit_reached' WHEN greatest(coalesce(r, 0), coalesce(t, 0)) >= 0.8 THEN 'warning' ELSE 'healthy' END AS level
FROM nation LEFT JOIN g ON n_nationkey = g.tenant LEFT JOIN c ON n_nationkey = c.tenant""")
def platform_ops_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Tenants beside their usage and counts; each side is aggregated before it is joined."""
    day = F.col("ts") >= _ntz(DAY)
    g = _events(spark, sf).groupBy(F.col("tenant").cast("int").alias("n_nationkey")).agg((F.count_if(day) / 60.0).alias("r"), (F.coalesce(F.sum(F.when(day, F.col("k"))), F.lit(0)) / 3000.0).alias("t"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    r, t = F.coalesce("r", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    peak = F.greatest(r, t)
    level = F.when(F.col("n_nationkey") == 5, "paused").when(peak >= 1, "limit_reached").when(peak >= 0.8, "warning").otherwise("healthy")
    joined = table(spark, sf, "nation").join(g, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return joined.select(F.col("n_nationkey").alias("tenant"), F.coalesce("customers", F.lit(0)).alias("customers"), F.round(r, 6).alias("requests_ratio"), F.round(t, 6).alias("tokens_ratio"), level.alias("level"))


@registry.query("""SELECT o_orderkey, o_orderstatus, l_linenumber, l_shipdate FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS r FROM lineitem) l
ON o_orderkey = l_orderkey AND r = 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Each order beside its latest line: a largest struct per key, so that only aggregates are shuffled."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", "l_linenumber")).alias("m"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(last, o.o_orderkey == last.l_orderkey, "left").select("o_orderkey", "o_orderstatus", F.col("m.l_linenumber").alias("l_linenumber"), F.col("m.l_shipdate").alias("l_shipdate"))


@registry.query("SELECT user_id, event_id, event_type, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    top = windows.top_per_key(_events(spark, sf), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5, "place")
    return top.select("user_id", "event_id", "event_type", F.col("place").cast("bigint").alias("place"))


@registry.query("""WITH f AS (SELECT c_custkey, c_name, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), 'a')),
n AS (SELECT count(*) AS total FROM f), u AS (SELECT count(*) AS unfiltered FROM customer)
SELECT c_custkey, n_name, c_acctbal, total, unfiltered FROM (SELECT * FROM f ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50), n, u""")
def member_search_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a substring search, with the number of all hits and of all rows."""
    c = table(spark, sf, "customer")
    joined = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = joined.filter(F.lower(F.concat_ws(" ", "c_name", "n_name", "c_mktsegment")).contains("a"))
    totals = f.agg(F.count(F.lit(1)).alias("total")).crossJoin(c.agg(F.count(F.lit(1)).alias("unfiltered")))
    page = f.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey", "n_name", "c_acctbal")
    return page.crossJoin(F.broadcast(totals))


@registry.query("SELECT event_id, user_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 800) WHERE event_type = 'error' OR contains(props, '7')")
def limit_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    newest = _events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(800)
    return newest.filter((F.col("event_type") == "error") | F.col("props").contains("7")).select("event_id", "user_id", "event_type")


@registry.query("""WITH l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
s AS (SELECT *, 1 + sum(CASE WHEN d > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS path, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session""")
def session_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by gaps of over twelve hours: their kinds of events and the path through them."""
    s = windows.sessions(_events(spark, sf), "user_id", "ts", "event_id", 43_200)
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return s.groupBy("user_id", "session").agg(
        F.count(F.lit(1)).alias("events"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.array_join(path, ">").alias("path"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@registry.query("""SELECT event_id FROM events WHERE NOT (event_type IN ('error', 'signup') AND coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, ts + INTERVAL 7 DAY) <= TIMESTAMP '2024-01-20')""")
def purge_expired(spark: SparkSession, sf: str) -> DataFrame:
    """What a retention purge leaves: terminal rows go once revoked, or expired, by the cutoff."""
    e = _events(spark, sf)
    ends = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    return e.filter(~(F.col("event_type").isin("error", "signup") & (ends <= _ntz("2024-01-20 00:00:00")))).select("event_id")


QUEUE = """q AS (SELECT o_orderkey, o_orderdate, 100 - CASE WHEN o_orderpriority LIKE '1%' THEN 20 ELSE 0 END + CASE o_orderstatus WHEN 'O' THEN 30 WHEN 'P' THEN 40 ELSE -40 END
+ CASE WHEN o_totalprice > 300000 THEN 60 WHEN o_totalprice > 200000 THEN 40 WHEN o_totalprice > 100000 THEN 20 ELSE 0 END AS score,
CAST(greatest(15, trunc(CASE o_orderstatus WHEN 'O' THEN 180 WHEN 'P' THEN 240 ELSE 15 END * CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1.5 ELSE 1 END)) AS BIGINT) AS seconds, o_custkey % 5 AS tenant FROM orders)"""


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    kind = lambda a, b, c: F.when(F.col("o_orderstatus") == "O", a).when(F.col("o_orderstatus") == "P", b).otherwise(c)
    size = lambda a, b, c, d: F.when(price > 300000, a).when(price > 200000, b).when(price > 100000, c).otherwise(d)
    score = F.lit(100) - F.when(F.col("o_orderpriority").startswith("1"), 20).otherwise(0) + kind(30, 40, -40) + size(60, 40, 20, 0)
    seconds = F.greatest(F.lit(15), (kind(180, 240, 15) * size(3.0, 2.0, 1.5, 1.0)).cast("bigint"))
    return o.select("o_orderkey", "o_orderdate", score.alias("score"), seconds.cast("bigint").alias("seconds"), (F.col("o_custkey") % 5).alias("tenant"))


@registry.query(f"WITH {QUEUE} SELECT o_orderkey, score, seconds FROM q ORDER BY score, o_orderdate, o_orderkey LIMIT 25")
def queue_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf).orderBy("score", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "score", "seconds")


@registry.query(f"WITH {QUEUE} SELECT o_orderkey, tenant, seconds, CAST(sum(seconds) OVER (PARTITION BY tenant ORDER BY score, o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS eta FROM q")
def queue_eta(spark: SparkSession, sf: str) -> DataFrame:
    """Sums in priority order: five tenants hold all jobs, so that each one's sum is made of ranges of score and time."""
    q = _queue(spark, sf).withColumn("at", F.col("score") * F.lit(10**11) + F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return windows.prefix_sum(q, ["tenant"], "at", ["score", "o_orderdate", "o_orderkey"], "seconds", "eta").select("o_orderkey", "tenant", "seconds", "eta")


@registry.query(f"""WITH {EV} SELECT event_id, CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'purchase' THEN 'warning' WHEN k / 100.0 >= 0.95 THEN 'critical' ELSE 'info' END AS severity,
CASE WHEN event_type = 'error' THEN 'escalate_super_admin' WHEN event_type = 'purchase' THEN 'union_notify' WHEN k / 100.0 >= 0.95 THEN 'temporary_cooldown' ELSE 'record_only' END AS response FROM e""")
def event_severity(spark: SparkSession, sf: str) -> DataFrame:
    t, risk = F.col("event_type"), F.col("k") / 100.0 >= 0.95
    severity = F.when(t == "error", "critical").when(t == "purchase", "warning").when(risk, "critical").otherwise("info")
    response = F.when(t == "error", "escalate_super_admin").when(t == "purchase", "union_notify").when(risk, "temporary_cooldown").otherwise("record_only")
    return _events(spark, sf).select("event_id", severity.alias("severity"), response.alias("response"))


@registry.query("""WITH p AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'both' WHEN 2 THEN 'bug_and_journey' ELSE 'usage_and_ux' END AS mode, CASE user_id % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'bug_only' ELSE 'full' END AS level,
CASE WHEN event_type IN ('error', 'signup') THEN 'bug_journey' ELSE 'usage_ux' END AS category FROM events)
SELECT event_id, category, (mode = 'both' OR (mode = 'bug_and_journey' AND category = 'bug_journey') OR (mode = 'usage_and_ux' AND category = 'usage_ux')) AND (level = 'full' OR (level = 'bug_only' AND category = 'bug_journey')) AS allowed FROM p""")
def telemetry_policy(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    mode = F.when(u % 4 == 0, "none").when(u % 4 == 1, "both").when(u % 4 == 2, "bug_and_journey").otherwise("usage_and_ux")
    level = F.when(u % 3 == 0, "off").when(u % 3 == 1, "bug_only").otherwise("full")
    bug = F.col("event_type").isin("error", "signup")
    by_mode = (mode == "both") | ((mode == "bug_and_journey") & bug) | ((mode == "usage_and_ux") & ~bug)
    return _events(spark, sf).select("event_id", F.when(bug, "bug_journey").otherwise("usage_ux").alias("category"), (by_mode & ((level == "full") | ((level == "bug_only") & bug))).alias("allowed"))


@registry.query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_ready_docs(spark: SparkSession, sf: str) -> DataFrame:
    ready = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(ready, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@registry.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000 AND o_custkey IS NOT NULL)")
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    dear = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(dear, "c_custkey", "left_anti").select("c_custkey", "c_name")


@registry.query("SELECT event_id, coalesce(json_extract_string(props, '$.member_visible'), 'true') AS visible FROM events WHERE coalesce(json_extract_string(props, '$.member_visible'), 'true') = 'true' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_default_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("visible", F.coalesce(F.get_json_object("props", "$.member_visible"), F.lit("true")))
    return e.filter((F.col("visible") == "true") & (F.col("k") >= 50)).select("event_id", "visible")


@registry.query("SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type)")
def rollup_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@registry.query("SELECT n_name, r_name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def union_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@registry.query(f"""WITH {EV} SELECT tenant, count(*) AS total, count(*) FILTER (k >= 20) AS ready, count(*) FILTER (coalesce(k, 0) < 20) AS pending, count(*) FILTER (event_type = 'error') AS blocked, bool_or(event_type = 'error') AS any_blocked, min(event_id) AS first_id FROM e GROUP BY tenant""")
def readiness_counts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce("k", F.lit(0))
    error = F.col("event_type") == "error"
    return _events(spark, sf).groupBy("tenant").agg(F.count(F.lit(1)).alias("total"), F.count_if(k >= 20).alias("ready"), F.count_if(k < 20).alias("pending"), F.count_if(error).alias("blocked"), F.bool_or(error).alias("any_blocked"), F.min("event_id").alias("first_id"))


@registry.query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events WHERE NOT (user_id % 11 = 0 AND event_type = 'view')")
def cascading_purge(spark: SparkSession, sf: str) -> DataFrame:
    """A user purge: some rows go, in others the user is blanked."""
    u = F.col("user_id")
    return _events(spark, sf).filter(~((u % 11 == 0) & (F.col("event_type") == "view"))).select("event_id", F.when(u % 7 != 0, u).alias("user_id"), "event_type")
