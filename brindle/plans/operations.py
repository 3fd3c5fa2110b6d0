"""Jobs, reviews, feeds, sessions, gates, keys and coercions of the platform, over events, orders, customers and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import hmac_sha256
from ..operators import windows
from ..sources.tables import table, tenant_scope
from .platform import DAY, EV, HOUR, NOW, _events, _ntz
from .registry import Registry

registry = Registry()


@registry.query(f"""WITH {EV}, g AS (SELECT tenant, count(*) FILTER (ts >= TIMESTAMP '{DAY}') AS reqs, CAST(coalesce(sum(k) FILTER (ts >= TIMESTAMP '{DAY}'), 0) AS BIGINT) AS tokens, round(coalesce(sum(value) FILTER (ts >= TIMESTAMP '{DAY}'), 0), 4) AS cost FROM e GROUP BY tenant),
u AS (SELECT tenant, user_id, count(*) FILTER (ts >= TIMESTAMP '{HOUR}') AS hourly FROM e GROUP BY ALL)
SELECT u.tenant, user_id, reqs, tokens, cost, hourly, CASE WHEN u.tenant = 9 THEN 'paused' WHEN reqs + 1 > 60 THEN 'request_cap' WHEN tokens + 100 > 3000 THEN 'token_cap' WHEN hourly + 1 > 1 THEN 'hourly_cap' ELSE 'allowed' END AS decision,
(reqs + 1) / 60.0 >= 0.8 OR (tokens + 100) / 3000.0 >= 0.8 OR cost / 5000.0 >= 0.8 AS warn FROM u JOIN g USING (tenant)""")
def quota_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Look-back sums of the tenant against its caps, of the user against the hourly one; the cost only warns."""
    day, hour = F.col("ts") >= _ntz(DAY), F.col("ts") >= _ntz(HOUR)
    u = _events(spark, sf).groupBy("tenant", "user_id").agg(
        F.count_if(day).alias("r"), F.coalesce(F.sum(F.when(day, F.col("k"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(day, F.col("value"))), F.lit(0.0)).alias("c"), F.count_if(hour).alias("hourly"),
    )
    g = u.groupBy("tenant").agg(F.sum("r").alias("reqs"), F.sum("t").alias("tokens"), F.round(F.sum("c"), 4).alias("cost"))
    decision = (
        F.when(F.col("tenant") == 9, "paused").when(F.col("reqs") + 1 > 60, "request_cap").when(F.col("tokens") + 100 > 3000, "token_cap")
        .when(F.col("hourly") + 1 > 1, "hourly_cap").otherwise("allowed")
    )
    warn = ((F.col("reqs") + 1) / 60.0 >= 0.8) | ((F.col("tokens") + 100) / 3000.0 >= 0.8) | (F.col("cost") / 5000.0 >= 0.8)
    return u.select("tenant", "user_id", "hourly").join(g, "tenant").select("tenant", "user_id", "reqs", "tokens", "cost", "hourly", decision.alias("decision"), warn.alias("warn"))


WEEK = "2024-01-24 00:00:00"
_OPEN = "('F', 'P')"


@registry.query(f"""WITH {EV}, u AS (SELECT count(*) FILTER (ts >= TIMESTAMP '{DAY}') AS requests_last_24h, CAST(coalesce(sum(k) FILTER (ts >= TIMESTAMP '{DAY}'), 0) AS BIGINT) AS tokens_last_24h, round(coalesce(sum(value) FILTER (ts >= TIMESTAMP '{DAY}'), 0), 4) AS cost_last_24h,
count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '{WEEK}') AS active_users_7d, count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type = 'signup') AS sign_ins_7d, count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type = 'error' AND k < 10) AS login_failures_7d,
count(*) FILTER (k = 7) AS pending_alerts, count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type = 'error') AS security_events_7d, count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type = 'error' AND k >= 50) AS query_failures_7d,
count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type = 'view') AS source_opens_7d, count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type = 'click') AS workspace_loads_7d, count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type IN ('error', 'signup')) AS journey_events_7d,
count(*) FILTER (ts >= TIMESTAMP '{WEEK}' AND event_type NOT IN ('error', 'signup')) AS usage_events_7d FROM e), d AS (SELECT count(*) FILTER (o_orderstatus IN {_OPEN} AND o_custkey % 3 = 0) AS open_review_items, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 2 = 0) AS ready_documents,
count(*) FILTER (o_orderstatus = 'F' OR (o_orderstatus IN {_OPEN} AND o_custkey % 3 = 0)) AS documents_needing_attention, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS uploads_7d FROM orders) SELECT * FROM u, d""")
def dashboard_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """All seventeen figures: one conditional aggregate per source table."""
    t, k, week, day = F.col("event_type"), F.col("k"), F.col("ts") >= _ntz(WEEK), F.col("ts") >= _ntz(DAY)
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    u = _events(spark, sf).agg(
        n(day, "requests_last_24h"), F.coalesce(F.sum(F.when(day, k)), F.lit(0)).alias("tokens_last_24h"), F.round(F.coalesce(F.sum(F.when(day, F.col("value"))), F.lit(0.0)), 4).alias("cost_last_24h"),
        F.count_distinct(F.when(week, F.col("user_id"))).alias("active_users_7d"), n(week & (t == "signup"), "sign_ins_7d"), n(week & (t == "error") & (k < 10), "login_failures_7d"), n(k == 7, "pending_alerts"),
        n(week & (t == "error"), "security_events_7d"), n(week & (t == "error") & (k >= 50), "query_failures_7d"), n(week & (t == "view"), "source_opens_7d"), n(week & (t == "click"), "workspace_loads_7d"),
        n(week & t.isin("error", "signup"), "journey_events_7d"), n(week & ~t.isin("error", "signup"), "usage_events_7d"),
    )
    o = table(spark, sf, "orders")
    s, c = F.col("o_orderstatus"), F.col("o_custkey")
    review = s.isin("F", "P") & (c % 3 == 0)
    d = o.agg(n(review, "open_review_items"), n((s == "O") & (c % 2 == 0), "ready_documents"), n((s == "F") | review, "documents_needing_attention"), n(F.col("o_orderdate") >= F.lit("1998-07-01").cast(o.schema["o_orderdate"].dataType), "uploads_7d"))
    return u.crossJoin(d)  # a row each


_BY_DAY = "count(*) AS requests, count(DISTINCT user_id) AS active_users, count(*) FILTER (event_type = 'error') AS security_events, count(*) FILTER (k = 7) AS notifications, count(*) FILTER (event_type = 'signup') AS sign_ins, count(*) FILTER (event_type IN ('error', 'signup')) AS journey_events, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS usage_events, count(*) FILTER (event_type = 'error' AND k >= 50) AS query_failures"
_METRICS = ("requests", "active_users", "security_events", "notifications", "sign_ins", "journey_events", "usage_events", "query_failures")


@registry.query(f"""WITH {EV}, c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), g AS (SELECT CAST(ts AS DATE) AS day, {_BY_DAY} FROM e GROUP BY 1)
SELECT strftime(c.day, '%Y-%m-%d') AS day, strftime(c.day, '%b %-d') AS label, {", ".join(f"coalesce({m}, 0) AS {m}" for m in _METRICS)} FROM c LEFT JOIN g USING (day)""")
def dashboard_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Eight metrics of seven days, zero where nothing happened."""
    t, k = F.col("event_type"), F.col("k")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    metrics = [
        F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("active_users"), n(t == "error", "security_events"), n(k == 7, "notifications"), n(t == "signup", "sign_ins"),
        n(t.isin("error", "signup"), "journey_events"), n(~t.isin("error", "signup"), "usage_events"), n((t == "error") & (k >= 50), "query_failures"),
    ]
    d = windows.dense_days(_events(spark, sf), F.to_date("ts"), "2024-01-25", 7, metrics, dict.fromkeys(_METRICS, 0))
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "MMM d").alias("label"), *_METRICS)


@registry.query(f"WITH {EV} SELECT event_id, tenant FROM e WHERE tenant % 2 = 1")
def tenant_rls_no_context(spark: SparkSession, sf: str) -> DataFrame:
    """Rows readable without a context: all of them where no tenant is set, else the tenant's; here the odd ones of a set context are read."""
    e = _events(spark, sf)
    unset = tenant_scope(e, F.col("tenant"), None, no_context=True).filter("tenant % 2 = 1")
    return unset.select("event_id", "tenant")


@registry.query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND (o_custkey % 3 = 0 OR o_orderpriority = '1-URGENT') AND (o_orderpriority LIKE '%HIGH%' OR o_orderpriority LIKE '%URGENT%')""")
def review_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Unresolved documents, under the filters that are given."""
    o = table(spark, sf, "orders")
    unresolved = F.col("o_orderstatus").isin("F", "P") & ((F.col("o_custkey") % 3 == 0) | (F.col("o_orderpriority") == "1-URGENT"))
    asked = F.lower("o_orderpriority").contains("high") | F.lower("o_orderpriority").contains("urgent")
    return o.filter(unresolved & asked).select("o_orderkey", "o_orderstatus")


@registry.query(f"""WITH {EV}, n AS (SELECT event_id, tenant, CASE k % 4 WHEN 0 THEN 'Document ready ' || k WHEN 1 THEN 'Security alert: ingestion_review_escalated' WHEN 2 THEN 'Security alert: other' ELSE 'Union alert: ingestion_review_required' END AS subject, event_type FROM e)
SELECT event_id, tenant, subject FROM n WHERE (starts_with(subject, 'Document ') OR subject IN ('Security alert: ingestion_review_escalated', 'Union alert: ingestion_review_required')) AND event_type <> 'click'""")
def review_notifications(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k") % 4
    subject = F.when(k == 0, F.concat(F.lit("Document ready "), F.col("k").cast("string"))).when(k == 1, "Security alert: ingestion_review_escalated").when(k == 2, "Security alert: other").otherwise("Union alert: ingestion_review_required")
    n = _events(spark, sf).withColumn("subject", subject)
    wanted = F.col("subject").startswith("Document ") | F.col("subject").isin("Security alert: ingestion_review_escalated", "Union alert: ingestion_review_required")
    return n.filter(wanted & (F.col("event_type") != "click")).select("event_id", "tenant", "subject")


@registry.query(f"""WITH {EV}, n AS (SELECT tenant, event_id, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE event_type = 'error' AND tenant % 3 <> 0), a AS (SELECT tenant, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS notes FROM n WHERE r <= 5 GROUP BY 1)
SELECT c_custkey, coalesce(notes, '') AS notes FROM customer LEFT JOIN a ON tenant = c_custkey % 10""")
def lateral_notifications(spark: SparkSession, sf: str) -> DataFrame:
    """Each document beside the five newest notifications of its tenant: the top is taken per tenant, then joined."""
    e = _events(spark, sf).filter("event_type = 'error' AND tenant % 3 != 0")
    top = windows.top_per_key(e, ["tenant"], [F.desc("ts"), F.desc("event_id")], 5, "r")
    notes = top.groupBy("tenant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("notes"))
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("tenant"))
    return c.join(notes, "tenant", "left").select("c_custkey", F.coalesce("notes", F.lit("")).alias("notes"))


@registry.query("""SELECT c_custkey, c_name, s_suppkey, coalesce(n, 0) AS uses, last_key FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def member_credentials_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Members and their unions, with a credential where there is one, and their usage, which is aggregated before the join."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("c_custkey"))
    u = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("uses"), F.max("o_orderkey").alias("last_key"))
    return c.join(s, "c_custkey", "left").join(u, "c_custkey", "left").select("c_custkey", "c_name", "s_suppkey", F.coalesce("uses", F.lit(0)).alias("uses"), "last_key")


ROLES = {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 2}


@registry.query("""WITH r AS (SELECT c_custkey, c_mktsegment, lower(c_name) AS n, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 9 END AS k FROM customer), p AS (SELECT *, row_number() OVER (ORDER BY k DESC, n DESC, c_custkey) AS place FROM r) SELECT c_custkey, c_mktsegment, place FROM p WHERE place BETWEEN 26 AND 50""")
def role_sorted_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page in the order that a caller names: roles by rank, then names, here downwards."""
    rank = F.coalesce(*[F.when(F.col("c_mktsegment") == r, n) for r, n in ROLES.items()], F.lit(9))
    keys = {"role": [rank, F.lower("c_name")], "name": [F.lower("c_name")]}["role"]
    order = [*[k.desc() for k in keys], F.col("c_custkey")]
    page = table(spark, sf, "customer").orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return page.filter("place > 25").select("c_custkey", "c_mktsegment", "place")


@registry.query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


@registry.query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS r FROM conversations) SELECT conv_id, turn, role FROM r WHERE r <= 10""")
def oldest_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten messages of each conversation."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return windows.top_per_key(c, ["conv_id"], [F.col("turn"), F.col("role")], 10)


@registry.query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 9 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS article, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 13 END AS section, CASE WHEN p_partkey % 3 = 0 THEN substr('abc', CAST(p_partkey % 2 + 1 AS INT), 1) END AS sub FROM part)
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY try_cast(article AS INT) IS NULL, try_cast(article AS INT), article, section NULLS FIRST, sub NULLS FIRST, p_partkey) AS place FROM p""")
def legal_order(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as numbers, before those that are none; sections and subsections with the bare ones first."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        k, "p_brand", F.when(F.col("p_size") % 9 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("article"), F.when(k % 4 != 0, k % 13).alias("section"),
        F.when(k % 3 == 0, F.substring(F.lit("abc"), (k % 2 + 1).cast("int"), F.lit(1))).alias("sub"),
    )
    number = F.expr("try_cast(article AS int)")
    w = Window.partitionBy("p_brand").orderBy(number.isNull(), number, "article", F.col("section").asc_nulls_first(), F.col("sub").asc_nulls_first(), "p_partkey")
    return p.select("p_partkey", "p_brand", F.row_number().over(w).cast("bigint").alias("place"))


JOBS = "j AS (SELECT o_orderkey AS job, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, o_orderdate AS started, o_orderkey % 3 AS attempts, o_custkey % 2 = 0 AS sparse FROM orders)"


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "running").when(k % 4 == 2, "succeeded").otherwise("failed")
    return table(spark, sf, "orders").select(k.alias("job"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("started"), (k % 3).alias("attempts"), (F.col("o_custkey") % 2 == 0).alias("sparse"))


@registry.query(f"WITH {JOBS} SELECT job, CASE WHEN status = 'running' AND started < TIMESTAMP '1997-01-01' - INTERVAL 1800 SECOND THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' AND started < TIMESTAMP '1997-01-01' - INTERVAL 1800 SECOND THEN NULL ELSE started END AS started FROM j")
def reclaim_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Running jobs that began over half an hour before become pending again."""
    stale = (F.col("status") == "running") & (F.col("started") < F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00' - INTERVAL 1800 SECOND"))
    return _jobs(spark, sf).select("job", F.when(stale, "pending").otherwise(F.col("status")).alias("status"), F.when(~stale, F.col("started")).alias("started"))


@registry.query(f"WITH {JOBS} SELECT job, status = 'failed' AND attempts < 2 OR (status = 'succeeded' AND sparse AND attempts < 1) AS retry, CASE WHEN status = 'succeeded' AND sparse AND attempts < 1 THEN attempts + 1 WHEN status = 'failed' AND attempts < 2 THEN attempts + 1 ELSE attempts END AS attempts FROM j")
def bounded_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that run once more: failed ones up to twice, sparse results once with recognition of the scan."""
    retry = ((F.col("status") == "failed") & (F.col("attempts") < 2)) | ((F.col("status") == "succeeded") & F.col("sparse") & (F.col("attempts") < 1))
    return _jobs(spark, sf).select("job", retry.alias("retry"), (F.col("attempts") + retry.cast("bigint")).alias("attempts"))


@registry.query(f"WITH {JOBS}, p AS (SELECT job, row_number() OVER (ORDER BY started, job) AS r FROM j WHERE status = 'pending' QUALIFY r <= 25) SELECT j.job, CASE WHEN p.r IS NOT NULL THEN 'running' ELSE status END AS status FROM j LEFT JOIN p USING (job) WHERE status = 'pending'")
def poll_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One poll: the 25 oldest pending jobs run."""
    pending = _jobs(spark, sf).filter("status = 'pending'")
    taken = pending.orderBy("started", "job").limit(25).select("job", F.lit(True).alias("taken"))
    return pending.join(F.broadcast(taken), "job", "left").select("job", F.when(F.col("taken"), "running").otherwise("pending").alias("status"))


@registry.query(f"""WITH {JOBS}, s AS (SELECT *, 30 + job % 90 AS seconds, job % 50 AS tenant FROM j), r AS (SELECT job, sum(seconds) OVER (PARTITION BY tenant ORDER BY started, job ROWS UNBOUNDED PRECEDING) AS eta FROM s WHERE status = 'pending')
SELECT s.job, s.status, CASE WHEN status = 'succeeded' THEN 0 WHEN status = 'failed' THEN NULL WHEN status = 'pending' THEN eta ELSE seconds END AS eta FROM s LEFT JOIN r USING (job)""")
def queue_eta_states(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds until a job is ready: those of all pending ones before it and its own; 0 once done, null once failed, its own while it runs."""
    s = _jobs(spark, sf).withColumn("seconds", 30 + F.col("job") % 90).withColumn("tenant", F.col("job") % 50)
    eta = F.sum(F.when(F.col("status") == "pending", F.col("seconds"))).over(Window.partitionBy("tenant").orderBy("started", "job").rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("status") == "succeeded", 0).when(F.col("status") == "failed", None).when(F.col("status") == "pending", F.col("e")).otherwise(F.col("seconds"))
    return s.withColumn("e", eta).select("job", "status", state.cast("bigint").alias("eta"))


GAP = 7200


@registry.query(f"""WITH t AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), g AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(before) > {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS session FROM t)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY ALL""")
def session_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events without two hours of silence between."""
    s = windows.sessions(_events(spark, sf), "user_id", "ts", "event_id", GAP)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@registry.query(f"""WITH s AS (SELECT user_id, max(ts) AS seen, min(ts) AS began FROM events GROUP BY user_id) SELECT user_id, seen < TIMESTAMP '{NOW}' - INTERVAL 12 HOUR AS idle, began < TIMESTAMP '{NOW}' - INTERVAL 29 DAY AS expired, epoch(TIMESTAMP '{NOW}') - epoch(seen) >= 300 AS refresh FROM s""")
def session_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Idle after twelve hours, over after 29 days, refreshed every five minutes at most."""
    s = _events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("seen"), F.min("ts").alias("began"))
    at = lambda span: F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL {span}")
    return s.select("user_id", (F.col("seen") < at("12 HOUR")).alias("idle"), (F.col("began") < at("29 DAY")).alias("expired"), (F.col("seen") <= at("300 SECOND")).alias("refresh"))


@registry.query("""WITH l AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last, user_id) AS r, count(*) OVER () AS c FROM l) SELECT user_id, n FROM r WHERE r > CAST(ceil(c * 0.1) AS BIGINT)""")
def evict_oldest(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that stay once the tenth with the oldest activity has gone."""
    last = _events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    gone = last.orderBy("last", "user_id").limit(-(-last.count() // 10))
    return last.join(gone.select("user_id"), "user_id", "left_anti").select("user_id", "n")


@registry.query(r"""WITH t AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS low, greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))) AS tokens FROM conversations WHERE role = 'user'),
s AS (SELECT *, regexp_matches(low, 'ignore (all|previous|prior) instructions|developer mode|system prompt|bypass guard') OR contains(low, 'thing') AS blocked, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - tokens AS used FROM t)
SELECT conv_id, turn, tokens, CASE WHEN blocked THEN 'prompt_blocked' WHEN used + tokens > 200 THEN 'quota_exceeded' WHEN (used + tokens) / 200.0 >= 0.8 THEN 'quota_warning' ELSE 'ok' END AS outcome FROM s""")
def guard_then_quota(spark: SparkSession, sf: str) -> DataFrame:
    """The guard before the quota: tokens are words, one at least; what a conversation used before counts."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint")
    t = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.greatest(words, F.lit(1).cast("bigint")).alias("tokens"), (low.rlike("ignore (all|previous|prior) instructions|developer mode|system prompt|bypass guard") | low.contains("thing")).alias("blocked"))
    used = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.col("blocked"), "prompt_blocked").when(F.col("used") > 200, "quota_exceeded").when(F.col("used") / 200.0 >= 0.8, "quota_warning").otherwise("ok")
    return t.withColumn("used", used).select("conv_id", "turn", "tokens", outcome.alias("outcome"))


@registry.query("""SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 <> 0""")
def message_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that are written: none of tenants that keep none."""
    return table(spark, sf, "conversations").filter("conv_id % 3 != 0").select("conv_id", "turn", "role", "text")


SECRET = "a key that a deployment sets"


@registry.query()
def anonymous_keys(spark: SparkSession, sf: str) -> DataFrame:
    """HMAC-SHA256 of the sorted JSON of session, union and user; null where all are null. SQL has no HMAC: the tests hold it against hmac."""
    u = F.col("user_id")
    e = _events(spark, sf).select("event_id", F.when(u % 5 != 0, F.concat(F.lit("u"), u.cast("string"))).alias("user"), F.when(u % 3 != 0, F.col("tenant").cast("string")).alias("union"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("s-é"), F.col("k").cast("string"))).alias("session"))
    return e.select("event_id", anonymous_key(F.col("session"), F.col("union"), F.col("user")).alias("key"))


def anonymous_key(session: Column, union: Column, user: Column, secret: str = SECRET) -> Column:
    """A key of the ids as sorted JSON: a blank behind each colon and comma, characters beyond ASCII escaped."""
    field = lambda name, c: F.concat(F.lit(f'"{name}": '), F.coalesce(F.concat(F.lit('"'), _escaped(c), F.lit('"')), F.lit("null")))
    seed = F.concat(F.lit("{"), field("session_id", session), F.lit(", "), field("union_id", union), F.lit(", "), field("user_id", user), F.lit("}"))
    return F.when(session.isNotNull() | union.isNotNull() | user.isNotNull(), hmac_sha256(seed, secret))


def _escaped(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    code = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    chars = F.transform(F.split(plain, ""), lambda x: F.when(x.rlike(r"^[\x20-\x7e]?$"), x).otherwise(code(x)))
    return F.array_join(chars, "")


@registry.query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 5) AS k, greatest(1, least(10, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 5))) AS clamped, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing,
map_extract_value(map_concat(MAP {'k': '0', 'a': 'x'}, MAP {'k': json_extract_string(props, '$.k')}), 'k') AS merged FROM events""")
def coercions(spark: SparkSession, sf: str) -> DataFrame:
    """Values read from JSON with defaults and bounds, and metadata merged so that the later one wins."""
    k = F.expr("coalesce(try_cast(get_json_object(props, '$.k') AS int), 5)")
    base, later = F.create_map(F.lit("k"), F.lit("0"), F.lit("a"), F.lit("x")), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    # The later entries, and those of the base that it lacks.
    merged = F.map_concat(F.map_filter(base, lambda n, _: ~F.map_contains_key(later, n)), later)
    e = table(spark, sf, "events").withColumn("merged", merged)
    return e.select("event_id", k.alias("k"), F.greatest(F.lit(1), F.least(F.lit(10), k)).alias("clamped"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"), F.col("merged")["k"].alias("merged"))


@registry.query(r"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || '{"score": ' || (event_id % 15) || '}' || chr(10) || '```' WHEN 1 THEN 'The score is {"score": ' || (event_id % 12) || '} as asked' WHEN 2 THEN 'no braces' ELSE '{"score": "high"}' END AS reply FROM events)
SELECT event_id, greatest(1, least(10, coalesce(try_cast(json_extract_string(CASE WHEN json_valid(nullif(regexp_extract(reply, '(?s)(\{.*\})', 1), '')) THEN regexp_extract(reply, '(?s)(\{.*\})', 1) END, '$.score') AS INT), 5))) AS score FROM r""")
def reply_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """A score out of a model's reply: from the first brace to the last one, between 1 and 10, 5 where there is none."""
    k = F.col("event_id")
    number = lambda n: F.concat(F.lit('{"score": '), (k % n).cast("string"), F.lit("}"))
    reply = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), number(15), F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("The score is "), number(12), F.lit(" as asked"))).when(k % 4 == 2, "no braces").otherwise('{"score": "high"}')
    e = table(spark, sf, "events").select("event_id", F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.score").alias("s"))
    return e.select("event_id", F.greatest(F.lit(1), F.least(F.lit(10), F.expr("coalesce(try_cast(s AS int), 5)"))).alias("score"))


@registry.query("""WITH t AS (SELECT o_custkey, list(CAST(o_orderkey % 40 - 5 AS INT)) AS l FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x > 0))), ',') AS articles FROM t""")
def integer_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted distinct positive numbers; made distinct before they are gathered."""
    t = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 40 - 5).cast("int").alias("x")).distinct()
    return t.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.filter(F.collect_list("x"), lambda x: x > 0)), ",").alias("articles"))


@registry.query("""WITH m AS (SELECT c_custkey, [c_nationkey, (c_nationkey * 3) % 25] AS own, [(c_custkey % 25), (c_custkey * 7) % 25] AS named FROM customer) SELECT c_custkey, array_to_string(list_sort(list_filter(list_distinct(named), lambda x: NOT list_contains(own, x))), ',') AS foreign_, len(list_intersect(own, named)) > 0 AS active FROM m""")
def foreign_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of other tenants that a text names: a difference of sets."""
    n, k = F.col("c_nationkey").cast("bigint"), F.col("c_custkey")
    m = table(spark, sf, "customer").select("c_custkey", F.array(n, n * 3 % 25).alias("own"), F.array(k % 25, k * 7 % 25).alias("named"))
    return m.select("c_custkey", F.array_join(F.array_sort(F.array_except("named", "own")), ",").alias("foreign_"), (F.size(F.array_intersect("own", "named")) > 0).alias("active"))


@registry.query(r"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), h AS (SELECT doc_id, CAST(contains(low, 'thing') AS INT) + CAST(contains(low, 'ation') AS INT) + CAST(contains(low, 'inter') AS INT) AS hits, (doc_id % 100) / 200.0::DOUBLE AS sim FROM d)
SELECT doc_id % 50 AS grp, max(hits) AS hits, round(max(sim), 6) AS sim, bool_or(hits >= 2 AND sim >= 0.18) AS strong, bool_or(hits >= 1 AND sim >= 0.10) AS strong_short FROM h GROUP BY 1""")
def strong_match_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any retrieved text is strong enough: two term hits and a similarity of 0.18, or one and 0.10 for short questions."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = sum((low.contains(t).cast("int") for t in ("thing", "ation", "inter")), F.lit(0))
    h = table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("grp"), hits.alias("hits"), ((F.col("doc_id") % 100) / 200.0).alias("sim"))
    strong = lambda n, s: F.bool_or((F.col("hits") >= n) & (F.col("sim") >= s))
    return h.groupBy("grp").agg(F.max("hits").alias("hits"), F.round(F.max("sim"), 6).alias("sim"), strong(2, 0.18).alias("strong"), strong(1, 0.10).alias("strong_short"))


@registry.query(r"""SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'thing|weapon') AS harmful, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS words, substr(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), 1, 120) AS preview FROM documents""")
def harmful_and_preview(spark: SparkSession, sf: str) -> DataFrame:
    """A guard's verdict beside a capped preview."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.lower(t).rlike("thing|weapon").alias("harmful"), F.size(T.runs(t, 1)).cast("bigint").alias("words"), F.substring(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "), 1, 120).alias("preview"))
