"""Ranking of parts and documents as retrieved rows; expansions of questions; citations and the confidence in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import legal as L
from ..operators import ranking as R
from ..operators import search, windows
from ..operators.version_tree import together
from ..sources.tables import checkpointed, table
from .questions import CLAUSES_SQL, QUESTIONS_SQL, clauses, questions
from .registry import Registry
from .retrieval import _cos_sql, _scored

registry = Registry()


@registry.query()
def fuzzy_bonus(spark: SparkSession, sf: str) -> DataFrame:
    """Bonuses of part names for terms with typing errors; difflib has no SQL form, the tests compute it row by row."""
    b = R.fuzzy_bonus(table(spark, sf, "part"), "p_partkey", "p_name", ["wigdet", "steel", "antigue"])
    return b.select("p_partkey", F.round("bonus", 6).alias("bonus"))


@registry.query("""SELECT p_partkey, least(0.1::DOUBLE, 0.08::DOUBLE * len(list_filter(list_distinct([lower(trim(p_name)), 'head clerk', 'red bolt', lower(p_type)]), lambda p: length(p) >= 6 AND contains(p, ' ') AND contains('how much is a red widget or a blue bolt for the head', p)))) AS bonus FROM part""")
def alias_bonus(spark: SparkSession, sf: str) -> DataFrame:
    aliases = F.array("p_name", F.lit("head clerk"), F.lit("red bolt"), "p_type")
    return table(spark, sf, "part").select("p_partkey", R.alias_bonus("How much is a red widget or a blue bolt for the head", aliases).alias("bonus"))


@registry.query(f"""WITH s AS (SELECT vec_id, score AS sim, (vec_id % 9) / 100.0::DOUBLE - CASE WHEN vec_id % 11 = 0 THEN 0.22::DOUBLE ELSE 0 END - CASE WHEN vec_id % 13 = 0 THEN 1.5::DOUBLE ELSE 0 END AS b, CASE WHEN vec_id % 7 = 0 THEN 0.08::DOUBLE ELSE 0 END AS a FROM {_cos_sql()})
SELECT vec_id, round(sim + CASE WHEN b > 0 THEN least(b, 0.05) ELSE b END + CASE WHEN b > -0.1 THEN a ELSE 0 END, 6) AS similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 20""")
def tenant_ranking(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    score = R.tenant_score(F.col("score"), (v % 9) / 100.0, v % 11 == 0, v % 13 == 0, F.when(v % 7 == 0, 0.08).otherwise(0.0))
    return search.top(_scored(spark, sf).select("vec_id", F.round(score, 6).alias("similarity")), "similarity", "vec_id", 20)


@registry.query("""WITH t AS (SELECT p_partkey, lower(p_name) AS t, list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda w: length(w) > 2) AS w FROM part)
SELECT p_partkey, round(p_partkey % 10 / 10.0::DOUBLE + CASE WHEN (contains(t, 'red') AND contains(t, 'widget')) OR contains(t, 'red a widget') OR contains('red a widget', t) OR (len(w) >= 2 AND contains('red a widget', w[1]) AND contains('red a widget', w[2])) OR contains(t, 'blue bolt and nut') OR contains('blue bolt and nut', t) OR (contains(t, 'blue') AND contains(t, 'bolt') AND contains(t, 'and') AND contains(t, 'nut')) OR (len(w) >= 2 AND contains('blue bolt and nut', w[1]) AND contains('blue bolt and nut', w[2])) THEN 0.5 ELSE 0 END, 6) AS score FROM t""")
def title_boost(spark: SparkSession, sf: str) -> DataFrame:
    matched = R.title_matches(F.col("p_name"), ["Red a Widget", "Blue bolt and nut"])
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_partkey") % 10 / 10.0 + F.when(matched, 0.5).otherwise(0.0), 6).alias("score"))


@registry.query(f"""WITH {CLAUSES_SQL}, r AS (SELECT clause_id, article, clause_id % 9 AS section, CASE WHEN clause_id % 5 = 0 THEN 'Appendix A' ELSE 'Article ' || article || ', Section ' || (clause_id % 9) END AS citation, title, text FROM c),
h AS (SELECT *, lower(citation || ' ' || title || ' ' || text) AS b FROM r WHERE regexp_matches(citation, '(?i)article\\s+\\d+')), s AS (SELECT *, CAST(contains(b, 'vacation') AS INT) + CAST(contains(b, 'service') AS INT) + CAST(contains(b, 'steel') AS INT) AS hits, CAST(contains(lower(title), 'red') AS INT) AS titled, article IN (3, 7) AS pref FROM h)
SELECT clause_id, section, hits + 0.75 * titled + CASE WHEN titled > 0 THEN 0.5 ELSE 0 END + CASE WHEN pref THEN 0.85 ELSE 0 END AS score FROM s WHERE hits >= 2 OR ((titled > 0 OR pref) AND hits >= 1) ORDER BY score DESC, section, clause_id LIMIT 4""")
def fallback_relevance(spark: SparkSession, sf: str) -> DataFrame:
    section = F.col("clause_id") % 9
    citation = F.when(F.col("clause_id") % 5 == 0, "Appendix A").otherwise(F.concat(F.lit("Article "), F.col("article").cast("string"), F.lit(", Section "), section.cast("string")))
    r = clauses(spark, sf).withColumn("section", section).withColumn("citation", citation)
    found = R.fallback_rows(r, "clause_id", "citation", "title", "text", "article", "section", ["vacation", "service", "steel"], ["red"], [3, 7], True)
    return found.select("clause_id", "section", F.col("score").cast("double").alias("score"))


#: The deployment's dictionaries: phrases, groups of synonyms, slang, and phrases told by patterns.
CONCEPTS = {"sick days": ["sick leave", "illness"], "fired": ["discharge", "just cause"]}
GROUPS = [["pay", "wage", "rate", "compensation"], ["overtime", "time and a half", "extra hours"], ["baker", "bakery clerk"]]
# Words of workers, and the words of contracts behind them.
SLANG = {
    "ot": "overtime", "pto": "vacation personal holiday time off", "fmla": "family medical leave", "loa": "leave of absence",
    "float": "personal holiday", "float day": "personal holiday", "float days": "personal holidays", "floater": "personal holiday", "floaters": "personal holidays", "floating holiday": "personal holiday",
    "fired": "discharge termination", "canned": "discharge termination", "let go": "discharge termination layoff", "pink slip": "discharge termination layoff",
    "written up": "discipline warning", "write up": "discipline warning", "writeup": "discipline warning",
    "my schedule": "work schedule hours", "when do i work": "schedule hours", "shift change": "schedule change", "called in": "call in reporting pay", "call out": "call in sick absence", "no call no show": "absence discipline",
    "health insurance": "health benefits health trust", "medical": "health benefits", "dental": "health benefits", "vision": "health benefits", "retirement": "pension",
    "raise": "wage increase progression", "bump": "wage increase step", "time and a half": "overtime premium", "double time": "overtime premium", "sunday pay": "sunday premium", "night pay": "night premium", "holiday pay": "holiday premium",
    "bereavement": "funeral leave", "maternity": "family care leave", "paternity": "family care leave", "jury duty": "jury service", "sick time": "sick leave", "sick days": "sick leave", "cashier": "all purpose clerk",
    "steward": "union steward union representative", "stewards conference": "annual union stewards conference union stewards work schedules", "rep": "union representative steward", "dues": "union dues",
    "union meeting": "union business leave", "union meeting night": "regular local union meeting scheduled later than 6:00 p.m.",
    "run through": "term of agreement expiration date end date", "in force through": "term of agreement expiration date end date",
    "dress code": "uniform appearance dress", "uniform": "dress code appearance", "break": "rest period", "lunch": "meal period", "tardiness": "attendance discipline", "late": "attendance tardiness", "late policy": "attendance discipline",
}
# Phrases that contracts don't hold as they are said, the words to add, and what the phrase is called.
DETECTORS = [
    (
        r"(?:\bcontract\b|\bagreement\b|\bcba\b).*(?:\bstart\b|\bbegin\b|\beffective\b).*(?:\bend\b|\bexpir)|(?:\bstart\b|\bbegin\b|\beffective\b).*(?:\bend\b|\bexpir).*(?:\bcontract\b|\bagreement\b|\bcba\b)"
        r"|\bterm\s*of\s*(?:agreement|contract)\b|\beffective\s*date\b|\bexpiration\s*date\b|\brun\s*through\b|\bin\s*force\s*through\b",
        "term of agreement effective date expiration date start date end date", "contract term pattern",
    ),
    (
        r"\bstewards?\b.*\b(conference|meeting)\b|\bunion\s*meeting\b.*\bstewards?\b",
        "annual union stewards conference adjust union stewards work schedules regular local union meeting scheduled later than 6:00 p.m.", "steward schedule pattern",
    ),
    (r"\bclose\b.*\bopen\b|\bopen\b.*\bclose\b", "minimum rest period between shifts relief periods lunch breaks", "close/open pattern"),
    (
        r"\bminimum\b.*\bhours?\b.*\bbetween\b.*\bshifts?\b|\bhours?\b.*\bbetween\b.*\bshifts?\b|\bbetween\b.*\bend\b.*\bshift\b.*\bstart\b.*\bnext\b",
        "minimum rest period between shifts relief periods lunch breaks", "inter-shift rest pattern",
    ),
    (r"\b(funeral|died|death)\b", "bereavement leave funeral leave paid days", "bereavement pattern"),
    (r"\b(store|location)\b.*\b(shut|closing|close)\b", "store closing severance pay", "store closing pattern"),
]
SKIP = ("what", "how", "the", "are", "does", "for", "with", "after", "per")


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]" if items else "CAST([] AS VARCHAR[])"


def _synonym_sql() -> str:
    parts = [f"CASE WHEN contains(low, '{p}') THEN {_list(e)} ELSE CAST([] AS VARCHAR[]) END" for p, e in CONCEPTS.items()]
    pairs = {w: [t for t in g if t != w][:3] for g in GROUPS for w in g}
    cases = " ".join(f"WHEN w = '{w}' THEN {_list(t)}" for w, t in pairs.items())
    parts.append(f"flatten(list_transform(list_filter(regexp_extract_all(low, '[a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(SKIP)}, w)), lambda w: CASE {cases} ELSE CAST([] AS VARCHAR[]) END))")
    parts += [f"CASE WHEN contains(low, '{t}') THEN {_list([x for x in g if x != t][:3])} ELSE CAST([] AS VARCHAR[]) END" for g in GROUPS for t in g if " " in t]
    return "flatten([" + ", ".join(parts) + "])"


@registry.query(f"""WITH {QUESTIONS_SQL}, t AS (SELECT q_id, question, list_filter({_synonym_sql()}, lambda t: NOT contains(low, t)) AS t FROM (SELECT *, lower(question) AS low FROM q)),
d AS (SELECT q_id, question, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM t)
SELECT q_id, CASE WHEN len(t) > 0 THEN question || ' (' || array_to_string(list_slice(t, 1, 5), ' ') || ')' ELSE question END AS expanded FROM d""")
def synonym_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("q_id", R.expand_synonyms(F.col("question"), CONCEPTS, GROUPS, SKIP).alias("expanded"))


#: What workers say, a phrase for each rule and some for several, beside the questions.
_SAID = [
    "Does {} count", "When does our contract start and when does it end", "can a steward go to the conference", "I close tonight and open tomorrow", "hours between shifts", "my uncle died", "the store is closing, do I get dues back",
    "Fired after no call no show", "late policy and float days", "the union meeting night and the stewards", "what is the {} rule for a cashier",
]
_SAID_SQL = f"""w AS (SELECT ({_list(list(SLANG))})[CAST(q_id % {len(SLANG)} AS INT) + 1] AS word, q_id, question FROM q), asked AS (SELECT q_id, CASE WHEN q_id % 3 = 0 THEN question ELSE replace(({_list(_SAID)})[CAST(q_id % {len(_SAID)} AS INT) + 1], '{{}}', word) END AS question FROM w)"""


def _slang_sql() -> str:
    rules = [(rf"\b{s}\b", t, s) for s, t in sorted(SLANG.items(), key=lambda x: -len(x[0]))] + DETECTORS
    steps = ["s0 AS (SELECT q_id, lower(question) AS low, question AS x, CAST([] AS VARCHAR[]) AS a FROM asked)"]
    for i, (p, t, label) in enumerate(rules):
        met = f"regexp_matches(low, '{p}') AND NOT contains(lower(x), '{t}')"
        steps.append(f"s{i + 1} AS (SELECT q_id, low, CASE WHEN {met} THEN x || ' ({t})' ELSE x END AS x, CASE WHEN {met} THEN list_append(a, '{label} -> {t}') ELSE a END AS a FROM s{i})")
    return ", ".join(steps) + f" SELECT q_id, x AS expanded, array_to_string(a, '; ') AS applied FROM s{len(rules)}"


@registry.query(f"WITH {QUESTIONS_SQL}, {_SAID_SQL}, {_slang_sql()}")
def slang_expansion(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("q_id") % len(items) + 1).cast("int"))
    said = F.when(F.col("q_id") % 3 == 0, F.col("question")).otherwise(F.replace(of(_SAID), F.lit("{}"), of(list(SLANG))))
    found = questions(spark, sf).select("q_id", R.expand_slang(said, SLANG, DETECTORS).alias("e"))
    return found.select("q_id", F.col("e.text").alias("expanded"), F.array_join("e.applied", "; ").alias("applied"))


def citations(text):
    """Articles with their sections, and Appendix A, in order and once each."""
    pattern = r"article\s+(\d+)(?:\s*,?\s*section\s+(\d+))?"
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)), lambda m: F.concat(
        F.lit("Article "), F.regexp_extract(m, pattern, 1), F.when(F.regexp_extract(m, pattern, 2) != "", F.concat(F.lit(", Section "), F.regexp_extract(m, pattern, 2))).otherwise("")))
    return F.array_distinct(F.concat(found, F.when(F.lower(text).contains("appendix a"), F.array(F.lit("Appendix A"))).otherwise(F.array().cast("array<string>"))))


@registry.query(rf"""WITH {CLAUSES_SQL}, m AS (SELECT clause_id, text, regexp_extract_all(lower(text), 'article\s+\d+(?:\s*,?\s*section\s+\d+)?') AS m FROM c),
f AS (SELECT clause_id, list_transform(m, lambda x: 'Article ' || regexp_extract(x, 'article\s+(\d+)', 1) || CASE WHEN regexp_extract(x, 'section\s+(\d+)', 1) <> '' THEN ', Section ' || regexp_extract(x, 'section\s+(\d+)', 1) ELSE '' END) AS l FROM m)
SELECT clause_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS citations FROM f""")
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(spark, sf).select("clause_id", F.array_join(citations(F.col("text")), "; ").alias("citations"))


@registry.query(rf"""WITH {CLAUSES_SQL}, f AS (SELECT clause_id, text, len(list_distinct(regexp_extract_all(lower(text), 'article\s+\d+'))) AS cited, clause_id % 7 = 0 AS invalid, (clause_id % 5) / 5.0::DOUBLE AS grounding, contains(lower(text), 'agree') AS unsure, clause_id % 3 = 0 AS urgent, contains(lower(text), 'union') AS escalates FROM c),
i AS (SELECT *, CASE WHEN cited > 0 AND invalid THEN 2 ELSE 0 END + CASE WHEN grounding < 0.7 THEN 1 ELSE 0 END + CASE WHEN cited = 0 AND length(text) > 60 AND NOT unsure THEN 1 ELSE 0 END + CASE WHEN urgent AND NOT escalates THEN 1 ELSE 0 END AS issues FROM f)
SELECT clause_id, issues, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1.0::DOUBLE - 0.15::DOUBLE * issues + CASE WHEN cited > 0 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN cited > 0 AND invalid THEN 0.3::DOUBLE ELSE 0 END + grounding) / 2)), 6) AS confidence, issues = 0 OR (unsure AND NOT (cited > 0 AND invalid)) AS valid FROM i""")
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence in an answer from its issues, its citations and how far its values are grounded."""
    text, k = F.col("text"), F.col("clause_id")
    cited = F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(article\s+\d+)"), F.lit(1)))) > 0
    f = clauses(spark, sf).select(k, "text", cited.alias("cited"), (k % 7 == 0).alias("wrong"), ((k % 5) / 5.0).alias("g"), F.lower(text).contains("agree").alias("unsure"), (k % 3 == 0).alias("urgent"), F.lower(text).contains("union").alias("escalates"))
    one = lambda c: c.cast("int")
    invalid = F.col("cited") & F.col("wrong")
    issues = 2 * one(invalid) + one(F.col("g") < 0.7) + one(~F.col("cited") & (F.length("text") > 60) & ~F.col("unsure")) + one(F.col("urgent") & ~F.col("escalates"))
    confidence = (1.0 - 0.15 * issues + 0.1 * one(F.col("cited")) - 0.3 * one(invalid) + F.col("g")) / 2
    return f.select("clause_id", issues.alias("issues"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 6).alias("confidence"), ((issues == 0) | (F.col("unsure") & ~invalid)).alias("valid"))


#: Answers that cite in each of the three forms, twice the same, without a known article, and not at all.
ANSWERS = (
    "According to Article {a}, Section 2, {n} is paid weekly. See Article 99 for more.", "{n} earns overtime after forty hours (Article {a}, Section 3). This is short (Article 4).",
    "**Article {a}** states that {n} is covered. Article 12 requires notice.", "Per Article {a} the {n} shift is posted. The shift of all is posted per Article 5",
    "Nothing is cited here about {n}.", "Under Article {a}, {n} is paid weekly. According to Article 8, {n} is paid weekly.", "Pay (Article 3) is due. A longer claim about {n} under Article 2, Section 1.",
)
_ANSWERS_SQL = f"a AS (SELECT p_partkey AS answer_id, replace(replace({_list(ANSWERS)}[CAST(p_partkey % {len(ANSWERS)} AS INT) + 1], '{{a}}', CAST(p_size AS VARCHAR)), '{{n}}', p_name) AS t FROM part)"
_FORMS_SQL = " UNION ALL ".join(
    f"SELECT answer_id, {i} AS form, generate_subscripts(l, 1) AS no, trim(regexp_extract(unnest(l), '{p}', {c})) AS claim, regexp_extract(unnest(l), '{p}', {d}) AS citation FROM (SELECT answer_id, regexp_extract_all(t, '{p}', 0) AS l FROM a)"
    for i, (p, c, d) in enumerate(L.CLAIM_FORMS)
)


#: So many citations at most are handed to all tasks; more are joined by shuffles.
FEW_CITATIONS = 20_000


def _answers(parts: DataFrame) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), (F.col("p_partkey") % len(ANSWERS) + 1).cast("int"))
    filled = F.replace(F.replace(text, F.lit("{a}"), F.col("p_size").cast("string")), F.lit("{n}"), F.col("p_name"))
    return parts.select(F.col("p_partkey").alias("answer_id"), filled.alias("answer"))


@registry.query(f"""WITH {_ANSWERS_SQL}, f AS ({_FORMS_SQL}), k AS (SELECT * FROM f WHERE claim <> '' AND (form <> 1 OR (length(claim) >= 10 AND NOT regexp_matches(lower(claim), '^(this|see|refer)')))),
ch AS (SELECT CASE WHEN g = 0 THEN 'Article ' || p_size || ', Section ' || (p_partkey % 4) ELSE 'Article ' || p_size END AS cite, arg_max(p_name, p_partkey) AS content FROM part, (VALUES (0), (1)) AS x(g) GROUP BY 1),
j AS (SELECT k.*, coalesce(x.content, y.content) AS cited_text FROM k LEFT JOIN ch x ON x.cite = k.citation LEFT JOIN ch y ON y.cite = 'Article ' || regexp_extract(k.citation, 'Article\\s+(\\d+)', 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY answer_id, substr(lower(claim), 1, 50) ORDER BY form, no) AS r FROM j WHERE cited_text IS NOT NULL) SELECT answer_id, claim, citation, cited_text FROM r WHERE r = 1""")
def claim_citation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """What answers claim, with what they cite for it and its text; a claim counts once, at its first place."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    # Parts are few bytes and would fall to few tasks; an answer's claims stay where it lies.
    pairs = _answers(together(p, "p_partkey")).select("answer_id", F.posexplode(L.claim_citations(F.col("answer"))).alias("place", "_p")).select("answer_id", "place", "_p.*")
    last = p.filter("p_name IS NOT NULL").groupBy("p_size", (F.col("p_partkey") % 4).alias("section")).agg(F.max_by("p_name", "p_partkey").alias("p_name"), F.max("p_partkey").alias("p_partkey"))
    article = F.concat(F.lit("Article "), F.col("p_size").cast("string"))
    cites = F.explode(F.array(F.concat(article, F.lit(", Section "), F.col("section").cast("string")), article))
    chunks = checkpointed(last.select("p_partkey", "p_name", cites.alias("cite")).groupBy("cite").agg(F.max_by("p_name", "p_partkey").alias("content")))
    if chunks.limit(FEW_CITATIONS + 1).count() <= FEW_CITATIONS:
        chunks = F.broadcast(chunks)
    exact, whole = chunks.select(F.col("cite").alias("citation"), F.col("content").alias("_exact")), chunks.select(F.col("cite").alias("_article"), F.col("content").alias("_whole"))
    pairs = pairs.withColumn("_article", F.concat(F.lit("Article "), F.regexp_extract("citation", r"Article\s+(\d+)", 1)))
    told = pairs.join(exact, "citation", "left").join(whole, "_article", "left").withColumn("cited_text", F.coalesce("_exact", "_whole")).filter("cited_text IS NOT NULL")
    first = windows.top_per_key(told.withColumn("_claim", F.substring(F.lower("claim"), 1, 50)), ["answer_id", "_claim"], [F.col("place")], 1)
    return first.select("answer_id", "claim", "citation", "cited_text")


@registry.query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM part), c AS (SELECT p_partkey // 5 AS q, list({'citation': CASE p_partkey % 4 WHEN 0 THEN 'Appendix A' WHEN 3 THEN NULL ELSE 'Article ' || p_size || ', Section 1' END, 'title': CASE WHEN p_partkey % 4 = 3 THEN 'ARTICLE ' || p_size || ' PAY' ELSE p_name END}) AS l FROM part GROUP BY 1),
e AS (SELECT q, l, CASE q % 5 WHEN 0 THEN 'Article ' || (q % 50 + 1) || ', Section 2' WHEN 1 THEN 'APPENDIX B' WHEN 2 THEN '' WHEN 3 THEN 'Section 1' END AS x FROM c), f AS (SELECT q, l, lower(coalesce(x, '')) AS x, regexp_extract(lower(coalesce(x, '')), 'article\\s*(\\d+)', 1) AS a FROM e)
SELECT q, x = '' OR len(list_filter(l, lambda c: (a <> '' AND (contains(lower(coalesce(c.citation, '')), 'article ' || a) OR contains(lower(coalesce(c.title, '')), 'article ' || a))) OR (contains(x, 'appendix') AND contains(lower(coalesce(c.citation, '')), 'appendix')) OR contains(lower(coalesce(c.citation, '')), x))) > 0 AS hit FROM f""")
def citation_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an expected citation is among those found: by its article, as an appendix, or by its words."""
    k, article = F.col("p_partkey"), F.concat(F.lit("Article "), F.col("p_size").cast("string"))
    cited = F.when(k % 4 == 0, "Appendix A").when(k % 4 != 3, F.concat(article, F.lit(", Section 1")))
    title = F.when(k % 4 == 3, F.concat(F.upper(article), F.lit(" PAY"))).otherwise(F.col("p_name"))
    found = table(spark, sf, "part").groupBy(F.expr("p_partkey div 5").alias("q")).agg(F.collect_list(F.struct(cited.alias("citation"), title.alias("title"))).alias("l"))
    q = F.col("q")
    expected = F.when(q % 5 == 0, F.concat(F.lit("Article "), (q % 50 + 1).cast("string"), F.lit(", Section 2"))).when(q % 5 == 1, "APPENDIX B").when(q % 5 == 2, "").when(q % 5 == 3, "Section 1")
    return found.select("q", L.citation_hit(expected, F.col("l")).alias("hit"))


@registry.query(f"""WITH {QUESTIONS_SQL}, n AS (SELECT q_id, lower(question) AS low FROM q) SELECT q_id, regexp_matches(low, '^(what|how|when|who|why|is|are|does|do|can|could|am)\\b') AS asks, regexp_matches(low, 'where .* (defined|definition)|what (is|are) the (hours|definition)') AS locates, regexp_matches(low, '^(is|are) there\\b|does .* (mention|cover)') AS presence, regexp_matches(low, '^(tell me|explain|and|what about)\\b') AS follows FROM n""")
def question_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a question asks, locates a definition, probes for presence or follows another."""
    low = F.lower("question")
    shapes = {"asks": r"^(what|how|when|who|why|is|are|does|do|can|could|am)\b", "locates": r"where .* (defined|definition)|what (is|are) the (hours|definition)", "presence": r"^(is|are) there\b|does .* (mention|cover)", "follows": r"^(tell me|explain|and|what about)\b"}
    return questions(spark, sf).select("q_id", *[low.rlike(p).alias(n) for n, p in shapes.items()])


@registry.query(f"""WITH {CLAUSES_SQL}, t AS (SELECT clause_id, lower(text) AS low FROM c) SELECT clause_id, CAST(contains(low, 'vacation') AS INT) + CAST(contains(low, 'weeks') AS INT) + CAST(contains(low, 'service') AS INT) + CAST(contains(low, 'paid') AS INT) >= 3 AS strong, contains(low, 'months of service') AS contiguous FROM t""")
def strong_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Three of a question's words, or its phrase as it stands."""
    low = F.lower("text")
    hits = sum((low.contains(w).cast("int") for w in ("vacation", "weeks", "service", "paid")), F.lit(0))
    return clauses(spark, sf).select("clause_id", (hits >= 3).alias("strong"), low.contains("months of service").alias("contiguous"))


@registry.query(f"""WITH {QUESTIONS_SQL}, n AS (SELECT q_id, lower(question) AS low, CASE WHEN q_id % 3 <> 0 THEN 'clerk' END AS role FROM q) SELECT q_id, role IS NOT NULL AND NOT {"(" + " OR ".join(f"contains(low, '{w}')" for w in L.WAGE_EXCLUDED) + ")"} AND regexp_matches(low, '\\b(rate|wage|pay|paid|progression|step|increase|hourly)\\b') AND (regexp_matches(low, '\\b\\d[\\d,]*\\s*hours?\\b') OR contains(low, 'basket hours')) AS wage FROM n""")
def contextual_wage(spark: SparkSession, sf: str) -> DataFrame:
    """Wage questions told by their context: a role, a word of pay and a number of hours."""
    low = F.lower("question")
    signal = low.rlike(r"\b(rate|wage|pay|paid|progression|step|increase|hourly)\b") & (low.rlike(r"\b\d[\d,]*\s*hours?\b") | low.contains("basket hours"))
    return questions(spark, sf).select("q_id", ((F.col("q_id") % 3 != 0) & ~L.contains_any(low, L.WAGE_EXCLUDED) & signal).alias("wage"))


NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


@registry.query(f"""WITH t AS (SELECT p_partkey, {_list(NUMBERS)}[p_partkey % 13 + 1] || ' weeks of ' || p_name AS t FROM part) SELECT p_partkey, CASE regexp_extract(t, '^([a-z]+)', 1) {" ".join(f"WHEN '{w}' THEN {i}" for w, i in NUMBERS.items())} END AS n FROM t""")
def word_numbers(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in NUMBERS])
    t = table(spark, sf, "part").select("p_partkey", F.concat(F.element_at(words, (F.col("p_partkey") % 13 + 1).cast("int")), F.lit(" weeks of "), "p_name").alias("t"))
    values = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return t.select("p_partkey", values[F.regexp_extract("t", "^([a-z]+)", 1)].alias("n"))


@registry.query(r"""WITH RECURSIVE a AS (SELECT p_partkey, trim(regexp_replace(lower(['Food  ' || p_name, 'non food ' || p_name, 'nonfood foods', 'NON FOODS of ' || p_type][p_partkey % 4 + 1]), '[^a-z0-9]+', ' ', 'g')) AS a FROM part),
w AS (SELECT p_partkey, [a] AS l, 1 AS k FROM a UNION ALL SELECT p_partkey, list_concat(l, list_filter(n, lambda x, i: NOT list_contains(l, x) AND list_position(n, x) = i)), k + 1 FROM (SELECT p_partkey, l, k, list_transform([replace(l[k], 'nonfood', 'non food'), replace(l[k], 'non food', 'nonfood'), regexp_replace(l[k], '\bfoods\b', 'food', 'g'), regexp_replace(l[k], '\bfood\b', 'foods', 'g')], lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS n FROM w WHERE k <= len(l)))
SELECT p_partkey, array_to_string(arg_max(l, k), '|') AS variants FROM w GROUP BY 1""")
def alias_variants(spark: SparkSession, sf: str) -> DataFrame:
    """All forms of a class's name with food and foods, nonfood and non food, until nothing new follows."""
    k = F.col("p_partkey") % 4
    a = F.when(k == 0, F.concat(F.lit("Food  "), "p_name")).when(k == 1, F.concat(F.lit("non food "), "p_name")).when(k == 2, "nonfood foods").otherwise(F.concat(F.lit("NON FOODS of "), "p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(L.alias_closure(a), "|").alias("variants"))


@registry.query(f"""WITH s AS (SELECT vec_id, label, 1 - (1 - score) AS sim FROM {_cos_sql()}), t AS (SELECT * FROM s WHERE label <> 4 ORDER BY sim DESC, vec_id LIMIT 20) SELECT vec_id, round(sim + CASE WHEN label = 3 THEN 0.3 ELSE 0 END, 6) AS similarity FROM t ORDER BY similarity DESC, vec_id LIMIT 10""")
def dense_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    """Twice the rows where the question names an article, filtered by metadata before, boosted and cut after."""
    s = _scored(spark, sf).filter("label != 4").select("vec_id", "label", F.col("score").alias("sim"))
    t = search.top(s, "sim", "vec_id", 20).select("vec_id", F.round(F.col("sim") + F.when(F.col("label") == 3, 0.3).otherwise(0.0), 6).alias("similarity"))
    return search.top(t, "similarity", "vec_id", 10)


@registry.query("""SELECT p_partkey, p_size FROM part WHERE p_type = 'SMALL' AND p_brand <> 'Brand#1' AND contains(lower(p_name), 'red') ORDER BY p_partkey LIMIT 20""")
def metadata_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Equality on metadata and a topic as a substring; the same filters again behind the search cost nothing."""
    p = table(spark, sf, "part").filter((F.col("p_type") == "SMALL") & (F.col("p_brand") != "Brand#1") & F.lower("p_name").contains("red"))
    return p.filter(F.col("p_type") == "SMALL").orderBy("p_partkey").limit(20).select("p_partkey", "p_size")


@registry.query("""WITH s AS (SELECT p_brand, p_partkey, (CASE WHEN p_type = 'LARGE' THEN 3 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 2 ELSE 0 END + p_size / 50.0)::DOUBLE AS score, p_size > 40 AS has FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_size_, p_partkey) AS r FROM (SELECT *, 0 AS p_size_ FROM s WHERE NOT has AND score >= 3.5)),
a AS (SELECT p_brand, p_partkey, score FROM k WHERE r <= 3 UNION ALL SELECT p_brand, p_partkey, score FROM s WHERE has) SELECT p_brand, p_partkey, round(score, 6) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS place FROM a""")
def letter_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are there, and up to three strong side letters that aren't, in one order."""
    score = F.when(F.col("p_type") == "LARGE", 3).otherwise(0) + F.when(F.col("p_name").contains("red"), 2).otherwise(0) + F.col("p_size") / 50.0
    s = table(spark, sf, "part").select("p_brand", "p_partkey", score.cast("double").alias("score"), (F.col("p_size") > 40).alias("has"))
    added = windows.top_per_key(s.filter("NOT has AND score >= 3.5"), ["p_brand"], [F.desc("score"), F.col("p_partkey")], 3)
    both = s.filter("has").unionByName(added)
    return both.select("p_brand", "p_partkey", F.round("score", 6).alias("score"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")).cast("bigint").alias("place"))


@registry.query("""WITH h AS (SELECT p_brand, p_partkey, p_size <= 10 AS hit, p_type = 'LARGE' AND p_size % 2 = 0 AS tabled FROM part), c AS (SELECT p_brand, bool_or(hit AND tabled) AS covered FROM h GROUP BY 1), m AS (SELECT h.p_brand, min(p_partkey) AS p_partkey FROM h JOIN c USING (p_brand) WHERE NOT covered AND tabled AND NOT hit GROUP BY 1)
SELECT p_brand, p_partkey, FALSE AS added FROM h WHERE hit UNION ALL SELECT p_brand, p_partkey, TRUE FROM m""")
def evidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The hits, and a row with a table for questions whose hits have none."""
    h = table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") <= 10).alias("hit"), ((F.col("p_type") == "LARGE") & (F.col("p_size") % 2 == 0)).alias("tabled"))
    covered = h.filter("hit AND tabled").select("p_brand").distinct()
    added = h.filter("tabled AND NOT hit").join(covered, "p_brand", "left_anti").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    return h.filter("hit").select("p_brand", "p_partkey", F.lit(False).alias("added")).unionByName(added.withColumn("added", F.lit(True)))


@registry.query("""WITH n AS (SELECT p_brand, p_size % 12 AS section, min(p_partkey) AS page, count(*) AS entries FROM part GROUP BY ALL) SELECT p_brand, section, page, entries FROM n""")
def nav_index(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each section."""
    return table(spark, sf, "part").groupBy("p_brand", (F.col("p_size") % 12).alias("section")).agg(F.min("p_partkey").alias("page"), F.count(F.lit(1)).alias("entries"))


@registry.query("""SELECT p_brand, p_type AS doc_type, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (p_size = 1) AS items FROM part GROUP BY ALL""")
def browse_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per contract and type, with the entries of a browser."""
    items = F.array_join(F.array_sort(F.collect_list(F.when(F.col("p_size") == 1, F.col("p_partkey")))), ",")
    return table(spark, sf, "part").groupBy("p_brand", F.col("p_type").alias("doc_type")).agg(F.count(F.lit(1)).alias("n"), F.nullif(items, F.lit("")).alias("items"))


@registry.query("""WITH s AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE contains(p_name, 'red') AND p_type <> 'LARGE') SELECT p_partkey, CASE WHEN r <= 40 THEN 'LARGE' ELSE p_type END AS doc_type, r <= 40 AS changed FROM s""")
def doc_type_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """The first forty rows that look like side letters get their type; the number of changes is bounded."""
    s = table(spark, sf, "part").filter(F.col("p_name").contains("red") & (F.col("p_type") != "LARGE")).select("p_partkey", "p_type")
    first = s.orderBy("p_partkey").limit(40).select("p_partkey", F.lit(True).alias("changed"))
    j = s.join(F.broadcast(first), "p_partkey", "left")
    return j.select("p_partkey", F.when(F.col("changed"), "LARGE").otherwise(F.col("p_type")).alias("doc_type"), F.coalesce("changed", F.lit(False)).alias("changed"))


@registry.query("""WITH p AS (SELECT l_orderkey, l_partkey, l_quantity, sha256(concat_ws('|', CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR))) AS sig FROM lineitem WHERE l_tax > 0.05), r AS (SELECT sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR))) AS sig, max(p_partkey % 300) AS page FROM part GROUP BY 1)
SELECT p.l_orderkey, p.l_partkey, r.page, count(*) AS n FROM p JOIN r USING (sig) GROUP BY ALL""")
def source_page_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Pages taken over where an operation's signature is that of a known one."""
    sig = lambda a, b: F.sha2(F.concat_ws("|", a.cast("string"), b.cast("int").cast("string")), 256)
    p = table(spark, sf, "lineitem").filter("l_tax > 0.05").select("l_orderkey", "l_partkey", sig(F.col("l_partkey"), F.col("l_quantity")).alias("sig"))
    r = table(spark, sf, "part").select(sig(F.col("p_partkey"), F.col("p_size")).alias("sig"), (F.col("p_partkey") % 300).alias("page")).groupBy("sig").agg(F.max("page").alias("page"))
    return p.join(r, "sig").groupBy("l_orderkey", "l_partkey", "page").agg(F.count(F.lit(1)).alias("n"))


@registry.query("""WITH r AS (SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'moa_2024' WHEN 1 THEN 'base' ELSE 'MOA final' END AS kind, p_name AS file, p_size - 5 AS page FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM r WHERE contains(lower(kind), 'moa') AND contains(lower(file), 'bolt') AND page > 0) SELECT p_brand, p_partkey, page FROM f WHERE r = 1""")
def provenance_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of the first reference whose type and file contain what is asked for."""
    k = F.col("p_partkey")
    r = table(spark, sf, "part").select("p_brand", k, F.when(k % 3 == 0, "moa_2024").when(k % 3 == 1, "base").otherwise("MOA final").alias("kind"), F.col("p_name").alias("file"), (F.col("p_size") - 5).alias("page"))
    fits = r.filter(F.lower("kind").contains("moa") & F.lower("file").contains("bolt") & (F.col("page") > 0))
    return fits.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.min_by("page", "p_partkey").alias("page"))


@registry.query("""WITH u AS (SELECT c_custkey, c_mktsegment AS class, c_nationkey AS months FROM customer), r(rule, class, least, words) AS (VALUES ('a', 'BUILDING', 0, 'red'), ('b', NULL, 12, 'bolt'), ('c', 'MACHINERY', 5, NULL)), x AS (SELECT c_custkey, rule FROM u, r WHERE (r.class IS NULL OR r.class = u.class) AND months >= least) SELECT c_custkey, string_agg(rule, ',' ORDER BY rule) AS rules FROM x GROUP BY 1""")
def applicable_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """Exceptions that apply to a user; the rules are a few rows of literals."""
    rules = [("a", "BUILDING", 0), ("b", None, 12), ("c", "MACHINERY", 5)]
    fits = [F.when((F.lit(True) if c is None else F.col("c_mktsegment") == c) & (F.col("c_nationkey") >= n), r) for r, c, n in rules]
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws(",", *fits).alias("rules")).filter("rules != ''")


@registry.query("""SELECT o_orderpriority, count(*) AS jobs, count(*) FILTER (o_custkey % 5 = 0) AS ocr_attempts, max(o_custkey % 3) AS most FROM orders GROUP BY 1""")
def ocr_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("o_custkey") % 5 == 0).alias("ocr_attempts"), F.max(F.col("o_custkey") % 3).alias("most"))
