"""Expressions for questions about labour contracts: wage and high-stakes intent, topics, mentions, document types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# What tells a question about wages, and what tells that it is none.
WAGE_KEYWORDS = (
    "my pay", "my wage", "my rate", "my salary", "my hourly", "wage rate", "pay rate", "hourly rate", "rate of pay", "what do i make", "what's my pay",
    "what am i making", "how much do i make", "how much should i make", "how much will i make", "how much should i be making", "what should i be making",
    "what should i make", "compensation", "starting pay", "experience pay", "step", "progression", "appendix a",
)
WAGE_EXCLUDED = ("vacation", "holiday", "sick", "time off", "pto", "personal day", "pay stub", "pay period", "pay check")
WAGE_PATTERNS = (
    r"how much (do|does|will|would|should) .+ (make|earn|get paid|be making|be earning)",
    r"what (is|are|should) (my|the) (pay|wage|rate)",
    r"what (is|are) .+ (pay|wage|rate)",
    r"what (do|does) .+ (make|earn|get paid)",
    r"what .+ (pay|wage|rate) .+ for",
    r"what (is|are|'s) the .+ rate of pay",
    r"what should i (make|be making|earn|be earning)",
    r"\$\d+.*hour",
)
WAGE_SUPPRESSED_TOPICS = ("overtime", "premiums", "breaks", "grievance", "discipline", "term")

# Topics of high stakes, what tells a live incident, and what tells that it is only supposed.
STAKES_PATTERNS = (
    r"\bdisciplin(e|ary|ed|ing)?\b", r"\bterminat(e|ed|ion|ing)\b", r"\bdischarg(e|ed)\b", r"\bfired\b", r"\bharass(ed|ment|ing)?\b",
    r"\bdiscriminat(ed|e|ion|ing)\b", r"\bretaliat(es|ed|e|ion|ing)\b", r"\bweingarten\b", r"\binvestigation(s)?\b",
    r"\bsuspend(ed|s|ing)?\b|\bsuspension\b", r"\bwritten up\b|\bwrite up\b", r"\bunsafe\b|\bdanger(ous)?\b|\binjur(y|ed)\b",
)
STAKES_WORDS = ("discharge", "termination", "fired", "discipline", "harassment", "discrimination", "retaliation", "safety", "injury", "immigration", "weingarten")
ACTIVE_PATTERNS = (
    r"(i'?m|i am|was|been|being|getting) (just\s+)?(fired|terminated|discharged)",
    r"(i'?m|i am|was|been|being|getting) (disciplined|written up|suspended)",
    r"(i|i am|i was|i got|i have been|i've been).*(written up|suspended)",
    r"(my\s+)?(manager|boss|supervisor).*(wrote me up|disciplined me|suspended me)",
    r"(i'?m|i am) being (harass|discriminat)",
    r"(i'?m|i am|i was) (harassed|discriminated against|retaliated against)",
    r"(harassing|discriminating\s+against|retaliating\s+against)\s+me",
    r"(my\s+)?(manager|boss|supervisor|coworker).*(harass|discriminat|retaliat)",
    r"(i'?m|i am|i was).*(called|summoned).*(disciplinary\s+)?(meeting|office)",
    r"(called|summoned) (into|to) (a\s+)?(meeting|office)",
    r"just (got|been|was) (terminated|fired|discharged|written up|suspended)",
    r"(manager|boss|supervisor).*(wants|asked|told|called).*(meeting|office|talk)",
    r"(i'?m|i am|i got|i was) injured",
    r"(right now|today|yesterday|just happened).*(fired|terminated|discharged|written up|suspended|harass|discriminat|retaliat|injur|unsafe)",
    r"(fired|terminated|discharged|written up|suspended|harass|discriminat|retaliat|injur|unsafe).*(right now|today|yesterday|just happened)",
)
SUPPOSED_PATTERNS = (
    r"\bwhat are my rights if\b", r"\bhypothetical(ly)?\b", r"\bin case\b", r"\bif i were\b", r"\bif this happens\b", r"\bwhat if\b", r"\bif someone\b",
    r"\bcould i\b", r"\bwould i\b",
)

# Topics in the order in which they are tried, on normalized questions.
TOPICS = (
    ("weingarten", r"weingarten|right\s*to\s*representation|union\s*rep"),
    ("health_benefits", r"health\s*(benefit|insurance|coverage|care)|medical\s*benefit|eligible.*(health|benefit)|benefit.*eligible"),
    ("probation", r"probation|probationary|trial\s*period|new\s*employee.*hours"),
    ("promotion", r"promot|advance|move up|basket.*hours|credit.*hours"),
    ("term", r"term\s*of|contract\s*term|agreement\s*term|term\s*of\s*(agreement|contract)|expir|effective\s*date|run\s*through|in\s*force\s*through|(?:contract|agreement|cba).*(?:start|begin|effective).*(?:end|expir)|(?:start|begin|effective).*(?:end|expir).*(?:contract|agreement|cba)"),
    ("personal_holiday", r"personal\s*holiday|float\s*(day|days)?|floater|pto"),
    ("bereavement", r"bereavement|funeral|death\s*in\s*the\s*family|died"),
    ("layoff", r"layoff|lay\s*off|bumping|displacement|reduction"),
    ("sick_leave", r"sick\s*leave|sick\s*day|illness|call\s*in\s*sick"),
    ("premiums", r"premium|night\s*pay|sunday\s*pay|sunday\s*premium|holiday\s*premium|holiday.*(premium|pay).*worked|worked.*holiday.*(premium|pay)|in\s+addition\s+to\s+(their|the)\s+hourly\s+rate|12\s*00\s*midnight.*6\s*00\s*a\s*m"),
    ("vacation", r"vacation|time\s*off|holiday|personal day"),
    ("overtime", r"overtime|over\s*time|ot|time\s*and\s*a\s*half"),
    ("grievance", r"grievance|arbitration|file\s*a\s*complaint"),
    ("discipline", r"disciplin|warning|write\s*up|written up|tardiness|tardy|\blate\b|attendance"),
    ("seniority", r"seniority|senior|how long|years of service"),
    ("breaks", r"break|lunch|meal\s*period|relief|rest\s*period|minimum\s*hours?\s*between\s*.*shifts?|hours?\s*between\s*.*shifts?|between\s*the\s*end\s*of\s*.*shift\s*and\s*the\s*start\s*of\s*.*next"),
    ("scheduling", r"schedul|shift|hours|when do i work"),
    ("wages", r"wage|wages|rate\s*of\s*pay|rates\s*of\s*pay|pay\s*rate|hourly\s*rate|how much.*make|what do i make"),
    ("minimum_wage", r"minimum\s*wage|colorado.*wage|\$15"),
    ("joint_committee", r"joint.*committee|labor.*management\s*committee"),
)

# Topics of a section's text, in the order in which they are listed.
SECTION_TOPICS = (
    ("vacation", r"\bvacation\b|\bpaid time off\b|\banniversary year\b"), ("seniority", r"\bseniority\b|\byears? of service\b|\blength of service\b"),
    ("wages", r"\bwages?\b|\brate of pay\b|\bhourly rate\b|\$\d"), ("grievance", r"\bgrievance\b|\barbitrat|\bdispute procedure\b"),
    ("discipline", r"\bdisciplin|\bdischarge\b|\btermination\b|\bjust cause\b"), ("scheduling", r"\bschedul|\bshift\b|\bposted\b|\bworkweek\b"),
    ("benefits", r"\bhealth\b|\bbenefits?\b|\bpension\b|\binsurance\b"), ("leave", r"\bleave\b|\bmedical leave\b|\bbereavement\b|\bsick leave\b"),
)
LEGAL_SIGNALS = (r"\bcollective bargaining agreement\b", r"\barticle\s+\d+\b", r"\bsection\s+\d+", r"\bthis agreement\b", r"\bemployer\b", r"\bunion\b")
POLICY_SIGNALS = r"\bpolicy\b|\bhandbook\b|\bprocedure\b|\bemployee handbook\b"
NOTICE_SIGNALS = r"\bnotice\b|\bannouncement\b|\beffective immediately\b"
MEMO_SIGNALS = r"\bmemo\b|\bmemorandum\b|\bto:|\bfrom:"

# Signals of questions about side letters, and of questions for values in tables.
LETTER_SIGNALS = ("letter of agreement", "letters of agreement", "letter of understanding", "letters of understanding", " side letter", "side-letter", " sideletter", " lou ")
LETTER_FOLLOWUPS = ("written notice", "30 days", "cancel", "discontinue", "discontinued", "discontinuing", "either party", "implement this procedure")
TABLE_SIGNALS = (
    "wage", "rate", "hourly", "pay scale", "step", "progression", "appendix", "accrual", "vacation schedule", "vacation accrual", "holiday pay", "matrix", "table",
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return any_of([text.contains(p) for p in parts])


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def normalized_question(text: Column) -> Column:
    """Lower-case runs of letters and digits, one blank between them; apostrophes within a word vanish."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[’`]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?<=\w)'(?=\w)", ""), "[^a-z0-9]+", " "))


def first_topic(question: Column) -> Column:
    """The first topic whose pattern the normalized question holds, or null."""
    return bound(normalized_question(question), _topic_of)


def _topic_of(norm: Column) -> Column:
    return F.coalesce(*[F.when(norm.rlike(p), F.lit(t)) for t, p in TOPICS])


def section_topics(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in SECTION_TOPICS]))


def wage_signals(question: Column) -> Column:
    """Number of keywords and patterns of a wage question that match; 0 where it is about time off."""
    return bound(F.lower(question), _wage_signals)


def _wage_hits(low: Column) -> list[Column]:
    return [low.contains(k) for k in WAGE_KEYWORDS] + [low.rlike(p) for p in WAGE_PATTERNS] + [low.rlike(r"\b(pay|wage|hourly)\b") & low.rlike(r"\b(for|as)\b")]


def _wage_signals(low: Column) -> Column:
    return F.when(contains_any(low, WAGE_EXCLUDED), F.lit(0)).otherwise(reduce(lambda a, b: a + b, [h.cast("int") for h in _wage_hits(low)]))


def high_stakes(question: Column) -> Column:
    """struct<topic, active, matched>: of high stakes; a live incident and no mere supposition; number of rules that match."""
    return bound(F.lower(question), _high_stakes)


def _topic_hits(low: Column) -> list[Column]:
    return [low.rlike(p) for p in STAKES_PATTERNS] + [low.rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])") for w in STAKES_WORDS]


def _high_stakes(low: Column) -> Column:
    topic, active, supposed = _topic_hits(low), [low.rlike(p) for p in ACTIVE_PATTERNS], [low.rlike(p) for p in SUPPOSED_PATTERNS]
    reset = any_of(active) & any_of(supposed)
    count = reduce(lambda a, b: a + b, [c.cast("int") for c in [*topic, *active, *supposed, reset]])
    return F.struct((any_of(topic) | any_of(active)).alias("topic"), (any_of(active) & ~any_of(supposed)).alias("active"), count.alias("matched"))


def personal_pay(norm: Column) -> Column:
    return norm.rlike(r"\b(my|me|i)\b") & norm.rlike(r"\b(pay|wage|salary|hourly|make|earn|rate)\b")


def _is_wage(low: Column, norm: Column) -> Column:
    """Signals of a wage question, unless its topic or the tone of a clause speaks against it and nothing is personal."""
    asked = norm.rlike(r"\b(what (do|am|should) i (make|earn|be making)|what'?s my pay|my pay|my wage|my salary)\b")
    of_role = norm.rlike(r"\b(what|how much)\b.*\b(do|does|is|are)\b.*\b(make|earn|paid|pay|wage|rate)\b")
    clause = norm.rlike(r"\b(shall|section|article|hereof|thereof|for all work performed|in addition to)\b")
    by_topic = F.coalesce(_topic_of(norm).isin(*WAGE_SUPPRESSED_TOPICS), F.lit(False)) & ~personal_pay(norm) & ~asked
    signals = ~contains_any(low, WAGE_EXCLUDED) & any_of(_wage_hits(low))
    return signals & ~(clause & ~personal_pay(norm) & ~of_role) & ~by_topic


def intent(question: Column) -> Column:
    """high_stakes before wage before contract; the cheap tests of each stand first, and the texts are made once."""
    def told(q: Column) -> Column:
        stakes = any_of(_topic_hits(q["low"]) + [q["low"].rlike(p) for p in ACTIVE_PATTERNS])
        return F.when(stakes, "high_stakes").when(_is_wage(q["low"], q["norm"]), "wage").otherwise("contract")

    return bound(F.struct(F.lower(question).alias("low"), normalized_question(question).alias("norm")), told)


def letter_mode(question: Column) -> Column:
    low = F.lower(question)
    explicit = contains_any(F.concat(F.lit(" "), low, F.lit(" ")), LETTER_SIGNALS)
    return F.when(explicit, "explicit").when(low.contains("agreement") & contains_any(low, LETTER_FOLLOWUPS), "followup").otherwise("none")


def wants_table(question: Column) -> Column:
    return contains_any(F.lower(question), TABLE_SIGNALS)


def tenure(question: Column) -> dict[str, Column]:
    """Hours and months of service that a question names, 0 where it names none; a number behind after, at or with comes first."""
    norm = normalized_question(question)

    def number(unit: str, digits: str) -> Column:
        led, bare = (F.regexp_extract(norm, p, 1) for p in (rf"\b(?:after|at|with)\s+(\d{{{digits}}})\s+{unit}s?\b", rf"\b(\d{{{digits}}})\s+{unit}s?\b"))
        return F.coalesce(F.when(led != "", led), F.when(bare != "", bare), F.lit("0")).cast("int")

    return {"hours": number("hour", "2,6"), "months": number("month", "1,3")}


def numbers_after(text: Column, word: str) -> Column:
    """The numbers behind a word such as article or section, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{word}\s*(\d+)"), F.lit(1))


def cross_references(text: Column, own: Column) -> Column:
    """article_N of every article that the text names, once each and in order, but for its own."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\barticle\s+([0-9]+[a-z]?)\b"), F.lit(1)), lambda n: F.concat(F.lit("article_"), n))
    return F.array_remove(F.array_distinct(found), F.concat(F.lit("article_"), F.lower(own.cast("string"))))


def document_type(title: Column, content_type: Column, text: Column) -> Column:
    """struct<type, confidence, mode> by signals of contracts, policies, notices and memos, then by length."""
    low = F.lower(F.concat(title, F.lit("\n"), text))
    legal = reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in LEGAL_SIGNALS])
    made = lambda kind, confidence, mode="generic": F.struct(F.lit(kind).alias("type"), F.round(confidence, 2).alias("confidence"), F.lit(mode).alias("mode"))
    short = F.lower(content_type).startswith("text/") & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < 250)
    return (
        F.when(legal >= 2, made("legal_contract", F.least(0.7 + legal * 0.08, F.lit(0.98)), "legal_structured"))
        .when(low.rlike(POLICY_SIGNALS), made("policy_handbook", F.lit(0.78))).when(low.rlike(NOTICE_SIGNALS), made("general_notice", F.lit(0.72)))
        .when(low.rlike(MEMO_SIGNALS), made("general_memo", F.lit(0.7))).when(short, made("general_notice", F.lit(0.58))).otherwise(made("unknown", F.lit(0.42)))
    )


def _news_in(known: Column):
    return lambda n: ~F.array_contains(known, n) & (n.cast("decimal(38,0)") > 2)


def grounding(answer: Column, context: Column) -> dict[str, Column]:
    """How far the amounts, shares and spans of time of an answer stand in its context: score and number of issues."""
    low_answer, low_context = F.lower(answer), F.lower(F.coalesce(context, F.lit("")))
    all_of = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    sets = [F.size(F.array_except(F.array_distinct(all_of(answer, p)), all_of(low_context, p))) for p in (r"\$(\d+(?:\.\d{2})?)", r"(\d+(?:\.\d+)?)\s*%")]
    times = []
    for p in (r"(\d+)\s*hours?\s*(?:per|a|each)\s*(?:week|day)", r"(\d+)\s*(?:consecutive\s+)?days?", r"(\d+)\s*weeks?", r"(\d+)\s*months?"):
        times.append(F.size(F.filter(all_of(low_answer, p), _news_in(all_of(low_context, p)))))
    exact, time = sets[0] + sets[1], reduce(lambda a, b: a + b, times)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.15 * exact - 0.1 * time))
    return {"issues": (exact + time).cast("bigint"), "score": F.round(score, 6)}


# The forms in which answers cite: ahead of a claim, behind it, and as the claim's subject; with the groups of claim and citation.
_CITED = r"\*?\*?(Article\s+\d+(?:,?\s*Section\s+\d+)?)\*?\*?"
CLAIM_FORMS = (
    (rf"(?i)(?:According to|Per|Under|As stated in)\s+{_CITED},?\s+(.+?)(?:\.|$)", 2, 1),
    (rf"(?i)(.+?)\s*(?:\(|\bper\b|\bunder\b)\s*{_CITED}\)?", 1, 2),
    (rf"(?i){_CITED}\s+(?:states?|provides?|requires?|specifies?)\s+(?:that\s+)?(.+?)(?:\.|$)", 2, 1),
)
NO_CLAIM, LEAST_CLAIM = ("this", "see", "refer"), 10
# A claim ahead of its citation begins where the match before ended, or else with a line: tries from each character behind the last
# citation find nothing more, and take time by the square of what they read.
_CLAIM_STARTS = ("", r"(?:\G|(?<=[\n\r\u0085\u2028\u2029]))", "")


def claim_citations(answer: Column) -> Column:
    """array<struct<claim, citation>>: what an answer claims and cites for it, by the three forms, one after the other.

    Claims ahead of their citation have ten characters or more and don't begin with a word of reference.
    """
    found = []
    for i, (pattern, claim, cited) in enumerate(CLAIM_FORMS):
        all_ = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(f"(?i){_CLAIM_STARTS[i]}({pattern.removeprefix('(?i)')})"), F.lit(1))
        pairs = F.transform(all_, lambda m: F.struct(F.trim(F.regexp_extract(m, pattern, claim)).alias("claim"), F.regexp_extract(m, pattern, cited).alias("citation")))  # noqa: B023
        if i == 1:
            pairs = F.filter(pairs, lambda x: (F.length(x["claim"]) >= LEAST_CLAIM) & ~F.lower(x["claim"]).rlike("^(" + "|".join(NO_CLAIM) + ")"))
        found.append(F.filter(pairs, lambda x: x["claim"] != ""))
    return F.concat(*found)


def citation_hit(expected: Column, citations: Column) -> Column:
    """Whether one of the citations (array<struct<citation, title>>) is the expected one: its article, an appendix at all, or its words; true where none is expected."""
    low = F.lower(F.coalesce(expected, F.lit("")))
    article = F.regexp_extract(low, r"article\s*(\d+)", 1)
    of = lambda c, name: F.lower(F.coalesce(c[name], F.lit("")))
    named = F.concat(F.lit("article "), article)
    one = lambda c: ((article != "") & (of(c, "citation").contains(named) | of(c, "title").contains(named))) | (low.contains("appendix") & of(c, "citation").contains("appendix")) | of(c, "citation").contains(low)
    return (low == "") | F.exists(citations, one)


#: More steps than the closure of any name has members: each rule replaces all places at once.
_CLOSURE_STEPS = 24


def alias_closure(name: Column) -> Column:
    """All forms of a class's name with food and foods, nonfood and non food, in the order in which they follow from one another."""
    even = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(t), "’`", "''"), r"(?<=\w)'(?=\w)", ""), "[^a-z0-9]+", " "))
    start = F.filter(F.array(even(F.coalesce(name, F.lit("")))), lambda t: t != "")

    def step(known: Column, k: Column) -> Column:
        t = F.get(known, k)
        new = [F.replace(t, F.lit("nonfood"), F.lit("non food")), F.replace(t, F.lit("non food"), F.lit("nonfood")), F.regexp_replace(t, r"\bfoods\b", "food"), F.regexp_replace(t, r"\bfood\b", "foods")]
        return F.when(t.isNull(), known).otherwise(F.array_union(known, F.filter(F.array(*[even(n) for n in new]), lambda n: n != "")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_CLOSURE_STEPS - 1)), start, step)
