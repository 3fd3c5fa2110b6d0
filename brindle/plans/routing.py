"""Questions: intent, topic, tenure and references; clauses: topics, types and cross-references; grounding of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import legal as L
from ..operators import windows
from ..sources.tables import table
from .questions import CLAUSES_SQL, QUESTIONS_SQL, clauses, questions
from .registry import Registry

registry = Registry()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted(pattern)})"


def _or(parts) -> str:
    return "(" + " OR ".join(parts) + ")"


def _sum(parts) -> str:
    return "(" + " + ".join(f"CAST({p} AS INTEGER)" for p in parts) + ")"


N_SQL = f"""{QUESTIONS_SQL}, n AS (SELECT q_id, question, lower(question) AS low,
trim(regexp_replace(regexp_replace(replace(replace(lower(question), '’', ''''), '`', ''''), '([a-z0-9_])''([a-z0-9_])', '\\1\\2', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM q)"""
TOPIC_SQL = "CASE " + " ".join(f"WHEN {_re('norm', p)} THEN '{t}'" for t, p in L.TOPICS) + " END"
_WAGE_HITS = [f"contains(low, {_quoted(k)})" for k in L.WAGE_KEYWORDS] + [_re("low", p) for p in L.WAGE_PATTERNS] + [f"({_re('low', r'\b(pay|wage|hourly)\b')} AND {_re('low', r'\b(for|as)\b')})"]
WAGE_SQL = f"CASE WHEN {_or(f'contains(low, {_quoted(k)})' for k in L.WAGE_EXCLUDED)} THEN 0 ELSE {_sum(_WAGE_HITS)} END"
_TOPIC_HITS = [_re("low", p) for p in L.STAKES_PATTERNS] + [_re("low", rf"(^|[^a-z0-9]){w}($|[^a-z0-9])") for w in L.STAKES_WORDS]
_ACTIVE, _SUPPOSED = [_re("low", p) for p in L.ACTIVE_PATTERNS], [_re("low", p) for p in L.SUPPOSED_PATTERNS]
_PERSONAL = f"({_re('norm', r'\b(my|me|i)\b')} AND {_re('norm', r'\b(pay|wage|salary|hourly|make|earn|rate)\b')})"
_ASKED = _re("norm", r"\b(what (do|am|should) i (make|earn|be making)|what'?s my pay|my pay|my wage|my salary)\b")
_OF_ROLE = _re("norm", r"\b(what|how much)\b.*\b(do|does|is|are)\b.*\b(make|earn|paid|pay|wage|rate)\b")
_CLAUSE = _re("norm", r"\b(shall|section|article|hereof|thereof|for all work performed|in addition to)\b")


@registry.query(f"WITH {N_SQL} SELECT q_id, {TOPIC_SQL} AS topic FROM n")
def topic_extract(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("q_id", L.first_topic(F.col("question")).alias("topic"))


@registry.query(f"WITH {N_SQL} SELECT q_id, CAST({WAGE_SQL} AS BIGINT) AS signals FROM n")
def wage_signals(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("q_id", L.wage_signals(F.col("question")).cast("bigint").alias("signals"))


@registry.query(f"WITH {N_SQL} SELECT q_id, {_or(_TOPIC_HITS + _ACTIVE)} AS high_stakes, {_or(_ACTIVE)} AND NOT {_or(_SUPPOSED)} AS active, CAST({_sum([*_TOPIC_HITS, *_ACTIVE, *_SUPPOSED, f'({_or(_ACTIVE)} AND {_or(_SUPPOSED)})'])} AS BIGINT) AS matched FROM n")
def high_stakes_context(spark: SparkSession, sf: str) -> DataFrame:
    h = L.high_stakes(F.col("question"))
    return questions(spark, sf).select("q_id", h["topic"].alias("high_stakes"), h["active"].alias("active"), h["matched"].cast("bigint").alias("matched"))


@registry.query(f"""WITH {N_SQL}, t AS (SELECT *, {TOPIC_SQL} AS topic FROM n), w AS (SELECT *, ({WAGE_SQL} > 0 AND NOT (coalesce(topic IN {L.WAGE_SUPPRESSED_TOPICS}, FALSE) AND NOT {_PERSONAL} AND NOT {_ASKED})
AND NOT ({_CLAUSE} AND NOT {_PERSONAL} AND NOT {_OF_ROLE})) AS wage FROM t) SELECT q_id, CASE WHEN {_or(_TOPIC_HITS + _ACTIVE)} THEN 'high_stakes' WHEN wage THEN 'wage' ELSE 'contract' END AS intent FROM w""")
def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    """High stakes come before wages, wages before the rest."""
    return questions(spark, sf).select("q_id", L.intent(F.col("question")).alias("intent"))


@registry.query(f"""WITH {N_SQL} SELECT q_id, CASE WHEN {_or(f"contains(' ' || low || ' ', {_quoted(s)})" for s in L.LETTER_SIGNALS)} THEN 'explicit'
WHEN contains(low, 'agreement') AND {_or(f'contains(low, {_quoted(s)})' for s in L.LETTER_FOLLOWUPS)} THEN 'followup' ELSE 'none' END AS letter_mode, {_or(f'contains(low, {_quoted(s)})' for s in L.TABLE_SIGNALS)} AS wants_table FROM n""")
def letter_and_table_modes(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("q_id", L.letter_mode(F.col("question")).alias("letter_mode"), L.wants_table(F.col("question")).alias("wants_table"))


def _number_sql(unit: str, digits: str) -> str:
    led, bare = (f"nullif(regexp_extract(norm, '{p}', 1), '')" for p in (rf"\b(?:after|at|with)\s+(\d{{{digits}}})\s+{unit}s?\b", rf"\b(\d{{{digits}}})\s+{unit}s?\b"))
    return f"CAST(coalesce({led}, {bare}, '0') AS INTEGER)"


@registry.query(f"WITH {N_SQL} SELECT q_id, {_number_sql('hour', '2,6')} AS hours, {_number_sql('month', '1,3')} AS months FROM n")
def tenure_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = L.tenure(F.col("question"))
    return questions(spark, sf).select("q_id", t["hours"].alias("hours"), t["months"].alias("months"))


@registry.query(f"WITH {N_SQL} SELECT q_id, array_to_string(regexp_extract_all(low, 'article\\s*(\\d+)', 1), ',') AS articles, array_to_string(regexp_extract_all(low, 'section\\s*(\\d+)', 1), ',') AS sections FROM n")
def explicit_references(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("q_id", *[F.array_join(L.numbers_after(F.col("question"), w), ",").alias(f"{w}s") for w in ("article", "section")])


#: Phrases that name a job class; longer phrases come first where two begin at one place.
MENTIONS = (("head clerk", "head_clerk"), ("clerk", "clerk"), ("courtesy clerk", "courtesy_clerk"), ("baker", "baker"), ("manager", "manager"), ("boss", "manager"))


@registry.query(f"""WITH {N_SQL}, p(phrase, value) AS (VALUES {", ".join(map(str, MENTIONS))}),
m AS (SELECT q_id, value, min(strpos(' ' || norm || ' ', ' ' || phrase || ' ') * 1000 - length(phrase)) AS place FROM n, p WHERE contains(' ' || norm || ' ', ' ' || phrase || ' ') GROUP BY q_id, value),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY place, value) AS r FROM m) SELECT q_id, r AS place, value FROM r WHERE r <= 3""")
def mention_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three classes that a question names, by place, longer phrases first; an equi-join on runs of one and two words."""
    norm = F.split(L.normalized_question(F.col("question")), " ")
    words = questions(spark, sf).select("q_id", norm.alias("w")).select("q_id", "w", F.posexplode("w").alias("i", "one"))
    starts = F.when(F.col("i") == 0, 0).otherwise(F.length(F.array_join(F.slice("w", 1, F.col("i")), " ")) + 1)
    runs = words.select("q_id", starts.alias("at"), F.explode(F.array("one", F.concat_ws(" ", "one", F.get("w", F.col("i") + 1)))).alias("phrase"))
    phrases = spark.createDataFrame(MENTIONS, "phrase string, value string")
    found = runs.join(F.broadcast(phrases), "phrase").groupBy("q_id", "value").agg(F.min(F.struct("at", (-F.length("phrase")).alias("n"))).alias("p"))
    top = windows.top_per_key(found, ["q_id"], [F.col("p.at"), F.col("p.n"), F.col("value")], 3, "place")
    return top.select("q_id", F.col("place").cast("bigint").alias("place"), "value")


@registry.query(f"""WITH {CLAUSES_SQL}, r AS (SELECT clause_id, article, regexp_extract_all(lower(text), '\\barticle\\s+([0-9]+[a-z]?)\\b', 1) AS f FROM c),
u AS (SELECT clause_id, article, f, unnest(generate_series(1, len(f))) AS i FROM r), d AS (SELECT clause_id, 'article_' || f[i] AS ref, min(i) AS i FROM u WHERE f[i] <> CAST(article AS VARCHAR) GROUP BY ALL)
SELECT r.clause_id, coalesce(string_agg(ref, ',' ORDER BY i), '') AS refs FROM r LEFT JOIN d ON r.clause_id = d.clause_id GROUP BY r.clause_id""")
def cross_references(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(spark, sf).select("clause_id", F.array_join(L.cross_references(F.col("text"), F.col("article")), ",").alias("refs"))


@registry.query(f"""WITH {CLAUSES_SQL} SELECT clause_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {_re('lower(text)', p)} THEN '{t}' END" for t, p in L.SECTION_TOPICS)}], lambda x: x IS NOT NULL), ',') AS topics FROM c""")
def topic_inference(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(spark, sf).select("clause_id", F.array_join(L.section_topics(F.col("text")), ",").alias("topics"))


_LOW = "lower(title || chr(10) || text)"
_LEGAL = _sum(_re(_LOW, p) for p in L.LEGAL_SIGNALS)


@registry.query(f"""WITH {CLAUSES_SQL}, d AS (SELECT clause_id, CASE WHEN clause_id % 2 = 0 THEN 'text/plain' ELSE 'application/pdf' END AS ct, {_LEGAL} AS legal, {_re(_LOW, L.POLICY_SIGNALS)} AS policy, {_re(_LOW, L.NOTICE_SIGNALS)} AS notice,
{_re(_LOW, L.MEMO_SIGNALS)} AS memo, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 250 AS short FROM c)
SELECT clause_id, CASE WHEN legal >= 2 THEN 'legal_contract' WHEN policy THEN 'policy_handbook' WHEN notice THEN 'general_notice' WHEN memo THEN 'general_memo' WHEN ct = 'text/plain' AND short THEN 'general_notice' ELSE 'unknown' END AS type,
round(CASE WHEN legal >= 2 THEN least(0.7::DOUBLE + legal * 0.08::DOUBLE, 0.98::DOUBLE) WHEN policy THEN 0.78 WHEN notice THEN 0.72 WHEN memo THEN 0.7 WHEN ct = 'text/plain' AND short THEN 0.58 ELSE 0.42 END, 2) AS confidence FROM d""")
def doc_type_classifier(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("clause_id") % 2 == 0, "text/plain").otherwise("application/pdf")
    d = clauses(spark, sf).select("clause_id", L.document_type(F.col("title"), kind, F.col("text")).alias("d"))
    return d.select("clause_id", "d.type", "d.confidence")


_ALL = lambda t, p: f"regexp_extract_all({t}, {_quoted(p)}, 1)"
_SET = lambda p: f"len(list_filter(list_distinct({_ALL('answer', p)}), lambda x: NOT list_contains({_ALL('lower(context)', p)}, x)))"
_TIME = lambda p: f"len(list_filter({_ALL('lower(answer)', p)}, lambda x: NOT list_contains({_ALL('lower(context)', p)}, x) AND CAST(x AS BIGINT) > 2))"


@registry.query(f"""WITH {CLAUSES_SQL}, p AS (SELECT clause_id, text AS answer, coalesce(lag(text, 6) OVER (PARTITION BY clause_id % 50 ORDER BY clause_id), '') AS context FROM c),
s AS (SELECT clause_id, {_SET(r'\$(\d+(?:\.\d{2})?)')} + {_SET(r'(\d+(?:\.\d+)?)\s*%')} AS exact,
{_TIME(r'(\d+)\s*hours?\s*(?:per|a|each)\s*(?:week|day)')} + {_TIME(r'(\d+)\s*(?:consecutive\s+)?days?')} + {_TIME(r'(\d+)\s*weeks?')} + {_TIME(r'(\d+)\s*months?')} AS times FROM p)
SELECT clause_id, CAST(exact + times AS BIGINT) AS issues, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * exact - 0.1::DOUBLE * times)), 6) AS score,
round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * exact - 0.1::DOUBLE * times)), 6) >= 0.7 AS grounded FROM s""")
def grounding_score(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts, percentages and spans of time of a text that the text before it doesn't hold."""
    before = F.coalesce(F.lag("text", 6).over(Window.partitionBy(F.col("clause_id") % 50).orderBy("clause_id")), F.lit(""))
    c = clauses(spark, sf).select("clause_id", F.col("text").alias("answer"), before.alias("context"))
    g = L.grounding(F.col("answer"), F.col("context"))
    return c.select("clause_id", g["issues"].alias("issues"), g["score"].alias("score"), (g["score"] >= 0.7).alias("grounded"))


#: A topic's standing where no evidence slot is named for it.
SLOTS = {"wages": ("rate_schedule", "progression_rules"), "vacation": ("vacation_entitlement", "vacation_scheduling_rules"), "grievance": ("grievance_steps", "timelines"), "discipline": ("discipline_procedure", "representation_rights")}


@registry.query(f"""WITH {N_SQL}, t AS (SELECT q_id, {TOPIC_SQL} AS topic, regexp_matches(norm, '\\b(difference|compare|comparison|vs\\.?|versus|between)\\b') AS comparison FROM n),
s(topic, slot) AS (VALUES {", ".join(str((t, s)) for t, x in SLOTS.items() for s in x)}) SELECT comparison, t.topic, slot, count(*) AS n FROM t LEFT JOIN s ON t.topic = s.topic GROUP BY ALL""")
def evidence_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence that questions of a topic need, and whether they compare; the slots are a small broadcast table."""
    q = questions(spark, sf).select(L.first_topic(F.col("question")).alias("topic"), L.normalized_question(F.col("question")).rlike(r"\b(difference|compare|comparison|vs\.?|versus|between)\b").alias("comparison"))
    slots = spark.createDataFrame([(t, s) for t, x in SLOTS.items() for s in x], "topic string, slot string")
    return q.join(F.broadcast(slots), "topic", "left").groupBy("comparison", "topic", "slot").agg(F.count(F.lit(1)).alias("n"))


@registry.query("""WITH l AS (SELECT conv_id, turn, role, text FROM conversations), h AS (SELECT conv_id, bool_or(regexp_matches(lower(text), '[?]')) AS asks, count(*) AS turns FROM l GROUP BY conv_id)
SELECT conv_id, turns, asks, max(CASE WHEN role = 'user' THEN turn END) AS last_user FROM l JOIN h USING (conv_id) GROUP BY conv_id, turns, asks""")
def conversation_state(spark: SparkSession, sf: str) -> DataFrame:
    """State of each conversation: turns, whether anything was asked, and the user's last turn."""
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_or(F.lower("text").rlike("[?]")).alias("asks"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"))
