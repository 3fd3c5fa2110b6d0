import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def beside_sql(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL over the same small tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda row: [(x is not None, x) for x in row]
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)


def test_redaction_beside_letters_of_other_languages_and_neighbouring_phones(spark, tmp_path):
    texts = [
        "é123-45-6789ü", "mail üa.b@c.orgé", "ñDOB: 04/05/1980é", "éaddress: 12 Elm Hill Road", "日本routing number 123456789é", "üacct # 12345678ü", "é4111 1111 1111 1111é", "ümember id AB-12345é",
        "ſecret: abcdef1 toKen=abcdef1", "token\x0b=abcdef1", "555\x0b123\x0b4567", "(555) 123-4567 (555) 123-4567 (555) 123-4567", "+1 555 123 4567 +1 555 123 4567", "5551234567\n", None, "",
    ]
    got, want = beside_sql(spark, tmp_path, "pii_redact", documents=pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert got == want and got[0][1] == "é***-**-6789ü" and sum(1 for r in got if r[2]) == 12


def test_pages_behind_many_offsets_take_time_in_proportion(spark):
    """A frame that shrinks row by row took minutes for as many rows of one document."""
    import time

    from pyspark.sql import functions as F

    from brindle.operators import structure

    n = 60_000
    pages = spark.range(n).select(F.lit(1).alias("c"), (F.col("id") * 3 + 2).alias("end"), F.col("id").alias("page"))
    offsets = spark.range(n).select(F.lit(1).alias("c"), F.col("id").alias("q"), (F.col("id") * 7 % (n * 3 + 50)).alias("at"))
    began = time.time()
    bad = structure.page_at(offsets, pages, "c", "at", "end", "page").filter(F.col("page") != F.least(F.greatest(F.ceil((F.col("at") - 2) / 3), F.lit(0)), F.lit(n - 1))).count()
    assert bad == 0 and time.time() - began < 20


def test_thresholds_against_a_walk_over_many_steps(spark):
    import random
    import time

    from brindle.operators import wages

    rng = random.Random(4)
    made = ["Start", "First {} hours worked", "Next {} Hours Worked", "next {} hours worked", "After {} hours", "after {} months", " Thereafter", "Bonus", None]
    weights = lambda c: [1, 1, 9, 9, 4, 2, 3, 2, 1] if c % 2 else [0, 0, 3, 3, 5, 2, 3, 2, 1]
    rows = [(c, i, s and s.format(rng.randint(0, 90))) for c in range(40) for i, s in enumerate(rng.choices(made, weights(c), k=rng.randint(1, 40)))]

    def walk(steps):
        gathered = None
        for s in steps:
            low, hours, months = (s or "").strip().lower(), None, None
            n = int(next((x for x in low.split() if x.isdigit()), 0))
            if low == "start":
                gathered, hours, months = 0, 0, 0
            elif low.startswith("after") and "hours" in low:
                gathered, hours = max(gathered or 0, n), n
            elif low.startswith("after"):
                months = n
            elif low.startswith("first"):
                gathered, hours = n, 0
            elif low.startswith("next"):
                gathered, hours = (gathered or 0) + n, gathered or 0
            elif low.startswith("thereafter"):
                hours = gathered
            yield hours, months

    got = {(r.c, r.i): (r.hours, r.months) for r in wages.step_thresholds(spark.createDataFrame(rows, "c int, i int, s string"), "c", "i", "s").collect()}
    want = {(c, i): x for c in range(40) for i, x in enumerate(walk([s for k, _, s in rows if k == c]))}
    assert got == want
    many = spark.range(60_000).selectExpr("1 AS c", "id AS i", "concat('Next ', id % 9, ' hours worked') AS s")
    began = time.time()
    assert wages.step_thresholds(many, "c", "i", "s").agg({"hours": "max"}).first()[0] == sum(i % 9 for i in range(59_999)) and time.time() - began < 20


def test_what_is_in_force_is_grouped_where_its_contract_lies(spark):
    """Ancestors times changes are many rows; they went through a shuffle of their own."""
    from brindle.operators import version_tree

    versions = spark.createDataFrame([(1, v, v - 1 or None) for v in range(1, 9)], "contract int, version int, parent int")
    changes = spark.createDataFrame([(1, v, t, v * 10 + t if v != 4 else None) for v in (2, 4, 5) for t in (v % 2, 3)], "contract int, version int, target int, value int")
    base = spark.createDataFrame([(1, 0, -1), (1, 7, -7), (2, 0, -2)], "contract int, target int, value int")
    rows = version_tree.rows_at(version_tree.ancestry(versions), changes, base)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.version, r.target): (r.value, r.from_version) for r in rows.collect() if r.contract == 1}
    assert {t: x for (v, t), x in got.items() if v == 8} == {1: (51, 5), 3: (53, 5), 7: (-7, None)} and {t: x for (v, t), x in got.items() if v == 3} == {0: (20, 2), 3: (23, 2), 7: (-7, None)}


def test_a_side_without_a_fork_is_merged_row_by_row(spark):
    from brindle.operators import version_tree

    df = lambda rows: spark.createDataFrame(rows, "fork int, target int, value int")
    got = version_tree.three_way(df([]), df([(None, 1, 5)]), df([(None, 1, 6)]), ["fork", "target"]).collect()
    assert [(r.state, r.our_value, r.their_value) for r in got] == [("conflict", 5, 6)]


def test_an_index_is_built_from_texts_that_are_cut_once(spark, tmp_path):
    """They were cut into words twice: for their mean length, and for their postings."""
    from pyspark.sql import functions as F

    from brindle.sources import postings

    read = spark.sparkContext.accumulator(0)

    def once(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(i, "the pay of the day " * (i % 5)) for i in range(40)], "doc_id bigint, text string").withColumn("text", F.udf(once)("text"))
    postings.build(docs, f"{tmp_path}/index", block_docs=8)
    index = postings.PostingIndex(spark, f"{tmp_path}/index")
    assert read.value == 40 and index.n == 40 and index.mean == 10.0
    assert index.frequencies(["the", "day", "night"]) == {"the": 32, "day": 32}


def test_scripts_of_diffs_are_made_where_their_row_is(spark, tmp_path):
    """Lines of both versions went through shuffles, joins and windows."""
    import __spark_entry__ as entry
    from brindle.operators import diffs

    script = diffs.line_diff(spark.createDataFrame([(1, "a\nb\nb\nc", "b\nc\nd\n"), (2, None, ""), (3, "", "x")], "id int, a string, b string"), "id", "a", "b")
    assert "Exchange" not in script._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in script.orderBy("id", "place").collect()]
    assert got == [(1, 0, "-", "a", 0, 0), (1, 1, "-", "b", 1, 0), (1, 2, " ", "b", 2, 0), (1, 3, " ", "c", 3, 1), (1, 4, "+", "d", 4, 2), (3, 0, "+", "x", 0, 0)] or got == [
        (1, 0, "-", "a", 0, 0), (1, 1, " ", "b", 1, 0), (1, 2, "-", "b", 2, 1), (1, 3, " ", "c", 3, 1), (1, 4, "+", "d", 4, 2), (3, 0, "+", "x", 0, 0)]
    texts = ["a\nb", "", "\n\n", "x", None, "the one\r\nthe two the one\n"]
    got, want = beside_sql(spark, tmp_path, "diff_rebuilds", documents=pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    assert [r[2] for r in got] == [True] * 5 and {r[0]: r[1] for r in got} == {0: 2, 1: 0, 2: 2, 3: 1, 5: 3}
    assert entry.queries()["diff_excerpts"](spark, str(tmp_path)).count() <= 5 and len(want) == 5


def test_similar_words_are_sought_in_many_tasks_and_hashed(spark):
    """A vocabulary is few bytes and fell to one task; texts in the aggregate had all that was joined sorted."""
    from brindle.operators import sequences

    df = lambda name, *words: spark.createDataFrame([(w,) for w in words], f"{name} string")
    found = sequences.similar_pairs(df("term", "vacation", "overtime"), df("word", "vacations", "overtimes", "vacancy", "vacation", "pay"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan
    assert {(r.term, r.word) for r in found.collect()} == {("vacation", "vacation"), ("vacation", "vacations"), ("overtime", "overtimes")}


def test_claims_ahead_of_citations_are_found_in_time_in_proportion(spark):
    """Each character behind the last citation was tried as a claim's first one."""
    import random
    import re
    import time

    from pyspark.sql import functions as F

    from brindle.functions import legal

    rng = random.Random(10)
    bits = ["Article 5", "article 12, Section 3", "**Article 7**", "(", ")", " per ", " under ", "Per ", "see ", "the pay is due", " ", "  ", "\n", "\r\n", "\u2028", ".", "a", "\U0001f600", "According to ", " requires that ", "supper", "*"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 24))) for _ in range(3000)]
    claimed, pattern = spark.createDataFrame([(t,) for t in texts], "t string"), legal.CLAIM_FORMS[1][0]
    plain = F.regexp_extract_all("t", F.lit(f"(?i)({pattern.removeprefix('(?i)')})"), F.lit(1))
    pairs = F.transform(plain, lambda m: F.struct(F.trim(F.regexp_extract(m, pattern, 1)).alias("claim"), F.regexp_extract(m, pattern, 2).alias("citation")))
    kept = F.filter(pairs, lambda x: (F.length(x["claim"]) >= 10) & ~F.lower(x["claim"]).rlike("^(this|see|refer)"))
    others = [F.size(F.filter(F.regexp_extract_all("t", F.lit(f"(?i)({p.removeprefix('(?i)')})"), F.lit(1)), lambda m: F.trim(F.regexp_extract(m, p, c)) != "")) for p, c, _ in (legal.CLAIM_FORMS[0], legal.CLAIM_FORMS[2])]  # noqa: B023
    got = claimed.select(legal.claim_citations(F.col("t")).alias("all"), others[0].alias("a"), others[1].alias("b"), kept.alias("want")).collect()
    assert all(list(r["all"][r.a : len(r["all"]) - r.b]) == list(r.want) for r in got) and sum(len(r.want) for r in got) > 500
    many = spark.createDataFrame([("Pay is given each week (Article 3)." + " no more is cited here" * 4000 + "\n" + "a line\n" * 9000 + "Work is ended by noon (Article 4)",)], "t string")
    began = time.time()
    assert [tuple(x) for x in many.select(legal.claim_citations(F.col("t")).alias("c")).first().c] == [("Pay is given each week", "Article 3"), ("Work is ended by noon", "Article 4")]
    assert time.time() - began < 10


def test_claims_stay_with_their_answers(spark, tmp_path, monkeypatch):
    """Parts fell to one task, and their claims were dealt out by citations, of which few are cited by all."""
    from brindle.plans import ranking

    n = 240
    parts = pa.table({"p_partkey": list(range(n)), "p_name": [None if i % 41 == 40 else f"part {i % 50}" for i in range(n)], "p_size": pa.array([i % 13 for i in range(n)], pa.int32())})
    got, want = beside_sql(spark, tmp_path, "claim_citation_pairs", part=parts)
    assert got == want and len(got) > 200
    rows = entry.queries()["claim_citation_pairs"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and plan.count("BroadcastHashJoin") == 2
    monkeypatch.setattr(ranking, "FEW_CITATIONS", 3)
    assert beside_sql(spark, tmp_path, "claim_citation_pairs", part=parts) == (want, want)


def test_a_long_line_of_versions_is_walked_in_rows_of_its_length(spark, tmp_path, monkeypatch):
    """All ancestors of all versions were stored, and those of each contract's last version used."""
    import datetime

    from brindle.operators import version_tree

    n, rows, plain = 160, [], version_tree.checkpointed
    owner = lambda i: 17 if i < n - 2 else i
    orders = pa.table({"o_orderkey": list(range(n)), "o_custkey": [owner(i) for i in range(n)], "o_orderdate": [datetime.datetime(1995, 1, 1) + datetime.timedelta(days=i * 7 % 50) for i in range(n)]})
    lines = [(i, t, i * 5 + t) for i in range(n) for t in range(1, 9) if (i * t) % 11 == 3]
    lineitem = pa.table({"l_orderkey": [x[0] for x in lines], "l_linenumber": pa.array([x[1] for x in lines], pa.int32()), "l_partkey": [x[2] for x in lines]})
    customer = pa.table({"c_custkey": [17, 18, n - 2, n - 1]})

    def counted(df):
        rows.append((stored := plain(df)).count())
        return stored

    monkeypatch.setattr(version_tree, "checkpointed", counted)
    got, want = beside_sql(spark, tmp_path, "patch_rebase", customer=customer, orders=orders, lineitem=lineitem)
    assert got == want and len(got) == 12 and max(rows) <= n and sum(rows) <= 8 * n  # 8 doublings


def test_lines_of_asked_versions_against_all_ancestors(spark):
    import random

    import pytest
    from pyspark.sql import functions as F

    from brindle.operators import version_tree

    rng = random.Random(12)
    rows = [(c, v, rng.choice([p for p in (v - 1, v - 1, v - 3) if p > 0] or [None, 99])) for c in range(6) for v in range(1, 3 + 7 * c)]
    versions = spark.createDataFrame(rows, "contract int, version int, parent int")
    asked = versions.filter("version % 4 = 1").select("contract", "version")
    line, every = version_tree.lineage(versions, asked), version_tree.ancestry(versions).join(asked, ["contract", "version"], "left_semi")
    assert sorted(tuple(r) for r in line.select(every.columns).collect()) == sorted(tuple(r) for r in every.collect()) and line.agg(F.max("distance")).first()[0] > 16
    changes = spark.createDataFrame([(c, v, v % 5, v * 10 if v % 6 else None) for c, v, _ in rows if v % 3], "contract int, version int, target int, value int")
    base = spark.createDataFrame([(c, t, -t) for c in range(6) for t in (1, 2, 7)], "contract int, target int, value int")
    last = versions.groupBy("contract").agg(F.max("version").alias("version"))
    told = version_tree.lineage(versions, last).join(changes.select("contract", F.col("version").alias("ancestor"), "target", "value"), ["contract", "ancestor"])
    want = version_tree.rows_at(version_tree.ancestry(versions).join(last, ["contract", "version"], "left_semi"), changes, base)
    key = lambda df: sorted(map(str, df.select("contract", "target", "value", "from_version").collect()))
    assert key(version_tree.rows_along(told, base)) == key(want) and want.count() > 12
    for circle in ([(1, 1, 3), (1, 2, 1), (1, 3, 2), (1, 5, None)], [(1, 1, 1), (1, 5, None)]):  # also beside what is asked for
        with pytest.raises(ValueError, match="ancestor"):
            version_tree.lineage(spark.createDataFrame(circle, "contract int, version int, parent int"), spark.createDataFrame([(1, 5)], "contract int, version int"))
    assert version_tree.lineage(versions.limit(0), asked.limit(0)).count() == 0
