import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import legal
from brindle.operators import metadata, ranking, tables, version_tree, wages
from brindle.sources.vector_sink import VectorSink

# ---- vector sink ----


def test_sink_against_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    sink, held = VectorSink(spark, f"{tmp_path}/sink", "id string, v array<float>, tag int", buckets=4), {}
    assert sink.count() == 0 and sink.current().collect() == [] and sink.get(["a"]).collect() == []
    ids = [f"k{i}" for i in range(30)]
    for step in range(12):
        some = rng.sample(ids, rng.randint(1, 12))
        match step % 6:
            case 0 | 1 | 4:
                rows = [(i, [float(step)], step) for i in some]
                sink.upsert(spark.createDataFrame([*rows, rows[0], (None, [0.0], 0)], "id string, v array<float>, tag int"))
                held |= {i: ([float(step)], step) for i in some}
            case 2:
                sink.delete(spark.createDataFrame([(i,) for i in [*some, "nowhere", None]], "id string"))
                held = {k: x for k, x in held.items() if k not in some}
            case 3:
                sink.compact()
                if step > 6:
                    sink.vacuum()
            case _:
                if step > 6:
                    continue
                sink.reset()
                held = {}
        assert sink.count() == len(held)
        assert {r.id: (list(r.v), r.tag) for r in sink.current().collect()} == held
        asked = [*rng.sample(ids, 5), "nowhere"]
        assert {r.id: (list(r.v), r.tag) for r in sink.get(asked).collect()} == {k: x for k, x in held.items() if k in asked}
    # Another reader sees the same; what no commit names isn't read.
    spark.createDataFrame([("k1", [9.0], 9, False, 1)], "id string, v array<float>, tag int, _gone boolean, _bucket int").write.partitionBy("_bucket").parquet(f"{tmp_path}/sink/data/99")
    again = VectorSink(spark, f"{tmp_path}/sink", "id string, v array<float>, tag int", buckets=4)
    assert {r.id for r in again.current().collect()} == set(held) and again.count() == len(held)


def test_of_two_writers_of_one_batch_the_second_fails(spark, tmp_path):
    sink = VectorSink(spark, f"{tmp_path}/sink", "id int, v int")
    sink.upsert(spark.createDataFrame([(1, 1)], "id int, v int"))
    with pytest.raises(Exception, match="exist"):
        sink._commit(0, 5, 0)
    assert sink.count() == 1


# ---- metadata ----


def merged(docs):
    """Later documents over earlier ones, one after the other."""

    def over(a, b):
        out = dict(a)
        for k, v in b.items():
            if v == {}:
                continue
            v = strip(v) if isinstance(v, dict) else v
            if v == {}:
                continue
            out[k] = over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    def strip(d):
        return {k: x for k, v in d.items() if (x := strip(v) if isinstance(v, dict) else v) != {}}

    state = {}
    for d in docs:
        state = over(state, strip(d))

    def walk(d, path):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from walk(v, (*path, k))
            else:
                yield (*path, k), json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    return dict(walk(state, ()))


def test_metadata_against_merging_one_by_one(spark):
    rng = random.Random(3)

    def made(depth):
        return {rng.choice("abc"): made(depth - 1) if depth and rng.random() < 0.5 else rng.choice([1, "x", None, True, [1, {"a": 2}], {}, 2.5]) for _ in range(rng.randint(0, 3))}

    rows, want = [], {}
    for k in range(120):
        docs = [made(3) for _ in range(rng.randint(1, 5))]
        rows += [(k, i, json.dumps(d)) for i, d in enumerate(docs)]
        want |= {(k, p): v for p, v in merged(docs).items()}
    rows += [(500, 0, None), (500, 1, "no json"), (500, 2, "[1]"), (500, 3, '"x"')]
    got = {(r.k, tuple(r.path)): r.value for r in metadata.merge_later_wins(spark.createDataFrame(rows, "k int, o int, j string"), "k", "o", "j").collect()}
    assert got == want


# ---- versions ----


def test_rows_and_forks_of_random_trees(spark):
    rng = random.Random(2)
    versions, changes, parents = [], [], {}
    for c in range(4):
        for v in range(1, 40 if c else 2):
            parent = rng.choice([None, *range(1, v)]) if v > 1 and rng.random() < 0.7 else (v - 1 or None)
            versions.append((c, v, parent))
            parents[c, v] = parent
            changes += [(c, v, t, rng.choice([None, v * 10 + t])) for t in rng.sample(range(5), rng.randint(0, 3))]
    versions.append((9, 1, 77))  # its parent is unknown
    parents[9, 1] = None
    base = [(c, t, -t - 1) for c in (0, 1, 2, 3, 9) for t in range(4)]
    ancestors = version_tree.ancestry(spark.createDataFrame(versions, "contract int, version int, parent int")).cache()

    def line(c, v):
        while v is not None:
            yield v
            v = parents[c, v]

    assert {(r.contract, r.version, r.ancestor): r.distance for r in ancestors.collect()} == {(c, v, a): d for c, v, _ in versions for d, a in enumerate(line(c, v))}
    rows = version_tree.rows_at(ancestors, spark.createDataFrame(changes, "contract int, version int, target int, value int"), spark.createDataFrame(base, "contract int, target int, value int"))
    want = {}
    for c, v, _ in versions:
        state = {t: (x, None) for k, t, x in base if k == c}
        for a in reversed(list(line(c, v))):
            state |= {t: (x, a) for k, w, t, x in changes if (k, w) == (c, a)}
        want |= {(c, v, t): x for t, x in state.items() if x[0] is not None}
    assert {(r.contract, r.version, r.target): (r.value, r.from_version) for r in rows.collect()} == want
    pairs = [(c, rng.randint(1, 39), rng.randint(1, 39)) for c in (1, 2, 3) for _ in range(20)]
    found = version_tree.common_ancestors(ancestors, spark.createDataFrame(sorted(set(pairs)), "contract int, ours int, theirs int")).collect()
    for r in found:
        ours, theirs = list(line(r.contract, r.ours)), list(line(r.contract, r.theirs))
        common = [a for a in ours if a in theirs]
        assert r.fork == (common[0] if common else None)
    assert len(found) == len(set(pairs))


def test_circles_of_versions_are_refused(spark):
    with pytest.raises(ValueError, match="ancestor"):
        version_tree.ancestry(spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 2)], "contract int, version int, parent int"))


def test_three_way_merge(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, value int")
    fork, ours, theirs = [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)], [(1, 1), (2, 2), (3, 1), (4, 2), (5, 2), (8, 8)], [(1, 1), (2, 1), (3, 3), (4, 2), (5, 3), (6, 1), (7, 7), (8, 9)]
    got = {r.k: (r.state, r.value) for r in version_tree.three_way(df(fork), df(ours), df(theirs), ["k"]).collect()}
    assert got == {1: ("same", 1), 2: ("ours", 2), 3: ("theirs", 3), 4: ("both", 2), 5: ("conflict", None), 6: ("ours", None), 7: ("theirs", 7), 8: ("conflict", None)}


def test_rebased_patches(spark):
    h = F.sha2(F.col("value").cast("string"), 256)
    rows = spark.createDataFrame([(1, 1, 5, None), (1, 2, 6, 40)], "contract int, target int, value int, from_version int")
    sha = {r.value: r.h for r in rows.select("value", h.alias("h")).collect()}
    ops = [(1, 10, 1, 1, sha[5]), (1, 10, 2, 2, "old"), (1, 11, 1, 1, "OLD"), (1, 11, 2, 9, "x"), (1, 12, 1, 2, None)]
    got = {(r.patch_id, r.op_no): (r.new_expected, r.changed, r.last_touch, r.error, r.status) for r in version_tree.rebase(spark.createDataFrame(ops, "contract int, patch_id int, op_no int, target int, expected string"), rows, h).collect()}
    assert got == {
        (10, 1): (sha[5], False, None, None, "success"), (10, 2): (sha[6], True, 40, None, "success"), (12, 1): (sha[6], True, 40, None, "success"),
        (11, 1): ("OLD", True, None, None, "failed"), (11, 2): ("x", None, None, "target_not_found", "failed"),
    }


# ---- tables, rates, words ----


def test_tables_are_withdrawn(spark):
    registry = [("c", 1, "t1", "h1", 5, ["Night Work", "Pay"]), ("c", 2, "t2", "h2", 5, ["Day Work"]), ("c", 3, "t3", "h3", 5, []), ("c", 4, "t4", "h1", None, None), ("d", 1, "t1", "h9", 5, ["x"])]
    pages = [("c", 1, "a", 5, "night work of all"), ("c", 2, "b", 5, "night work of all"), ("c", 3, "b", 5, "other"), ("c", 4, "h1", 7, ""), ("c", 5, None, 5, "zzz"), ("c", 6, "q", None, "day work"), ("c", 7, "q", 5, "DAY"), ("c", 8, "s", 5, "day work"), ("e", 1, None, None, None)]
    got = {(r.contract, r.place): (r.table_id, r.how) for r in tables.match_tables(
        spark.createDataFrame(pages, "contract string, place bigint, hash string, article int, heading string"),
        spark.createDataFrame(registry, "contract string, place bigint, table_id string, hash string, article int, path array<string>")).collect()}
    assert got == {
        ("c", 1): ("t1", "heading"), ("c", 2): ("tbl_fallback_art5_b", "synthesized"), ("c", 3): ("tbl_fallback_art5_b", "hash"), ("c", 4): ("t4", "hash"), ("c", 5): (None, "unparseable"),
        ("c", 6): ("tbl_fallback_art0_q", "synthesized"), ("c", 7): ("tbl_fallback_art0_q", "hash"), ("c", 8): ("t2", "heading"), ("e", 1): (None, "unparseable"),
    }


def test_sixty_slang_rules_build_and_run_at_once(spark):
    import time

    slang = {f"word{i}": f"term{i}" for i in range(60)} | {"let go": "discharge", "go": "leave"}
    began = time.time()
    df = spark.createDataFrame([("WORD5 and word59, let go",), ("word1 term1",), (None,)], "q string").select(ranking.expand_slang(F.col("q"), slang, [(r"\bdied\b", "x", "y")]).alias("e"))
    built, rows = time.time() - began, df.collect()
    assert built < 5
    assert (rows[0].e.text, rows[0].e.applied) == ("WORD5 and word59, let go (term59) (discharge) (leave)", ["word59 -> term59", "let go -> discharge", "go -> leave"])  # term59 holds term5
    assert rows[1].e.text == "word1 term1" and rows[1].e.applied == [] and rows[2].e.text is None


def test_wage_steps(spark):
    rates = [("a", "2022", "hours", 0, 10.0, 0.5, None, 1, "start"), ("a", "2022", "hours", 100, 11.0, 0.5, "t", 1, "next"), ("a", "2022", "hours", 100, 12.0, 0.9, None, 2, "next"), ("a", "2022", "fixed", None, 9.0, 0.5, "t", 3, "flat"), ("a", "2023", "fixed", None, 20.0, None, None, 1, None), ("b", "2022", "months", 6, 5.0, 0.1, "t", 1, "m")]
    asked = [(1, "a", "2022-05", 0, 0), (2, "a", "2022-05", 150, 0), (3, "a", "2022-05", None, 9), (4, "a", None, 5, 5), (5, "b", "2022-01", 500, 3), (6, "z", "2022-01", 1, 1), (7, "b", "2021", 0, 7)]
    got = {r.id: (r.effective_date, r.step, r.rate, r.evidence) for r in wages.wage_lookup(
        spark.createDataFrame(asked, "id int, class_key string, on string, hours int, months int"),
        spark.createDataFrame(rates, "class_key string, effective_date string, step_type string, threshold int, rate double, confidence double, table_id string, row_index int, step_name string")).collect()}
    assert got == {1: ("2022", "start", 10.0, 1), 2: ("2022", "next", 12.0, 1), 3: ("2022", "flat", 9.0, 1), 4: ("2023", "", 20.0, 1), 5: ("2022", "m", 5.0, 1), 6: (None, None, None, None), 7: ("2022", "m", 5.0, 1)}


def test_claims_hits_and_names(spark):
    rows = [("According to **Article 5, Section 2**, pay is weekly. Done.",), ("Pay is given each week (Article 3).",), ("see more under Article 4",), ("Article 7 requires that notice is given",), (None,)]
    got = [[tuple(x) for x in r.c] for r in spark.createDataFrame(rows, "t string").select(legal.claim_citations(F.col("t")).alias("c")).collect()]
    assert got[0] == [("pay is weekly", "Article 5, Section 2")] and got[1] == [("Pay is given each week", "Article 3")]
    assert got[2] == [] and got[3] == [("notice is given", "Article 7")] and got[4] == []
    names = spark.createDataFrame([("Non-Food's clerk",), ("",), (None,), ("nonfood",)], "n string").select(legal.alias_closure(F.col("n")).alias("v")).collect()
    assert names[0].v == ["non foods clerk", "nonfoods clerk", "non food clerk", "nonfood clerk"] and names[1].v == names[2].v == []
    assert names[3].v == ["nonfood", "non food", "non foods", "nonfoods"]
