import hashlib
import hmac
import json

from pyspark.sql import functions as F

from brindle.functions.keys import hmac_sha256
from brindle.plans.operations import SECRET, anonymous_key
from brindle.sources import artifacts as A
from brindle.sources.tables import chunk_artifacts, tenant_scope
from brindle.streaming import events


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_resolution_by_priority(spark, tmp_path):
    kinds, root = ["chunks_enriched", "chunks"], str(tmp_path)
    asked = lambda **kw: A.resolve(spark, A.candidates(root, kinds, "c1", f"{root}/v2", **kw))
    assert asked() is None
    put(tmp_path / "chunks.json", [])
    assert asked() == f"{root}/chunks.json" and asked(shared=False) is None
    put(tmp_path / "c1_chunks.json", [])
    put(tmp_path / "chunks_c1.json", [])
    assert asked() == f"{root}/chunks_c1.json"
    put(tmp_path / "v2/chunks_c1.json", [])
    assert asked() == f"{root}/v2/chunks_c1.json"
    put(tmp_path / "v2/chunks_enriched_c1.json", [{"chunk_id": "a", "contract_id": "c1"}, {"chunk_id": "b", "contract_id": None}])
    rows = chunk_artifacts(spark, asked(), "chunk_id string, contract_id string", "c1").collect()
    assert [r.chunk_id for r in rows] == ["a"]


def test_catalog_and_default(spark, tmp_path):
    put(tmp_path / "m/a.json", {"contract_id": "north_clerks_2022", "union_local": "7", "employer": "E", "term_start": "2022", "term_end": "2025", "region_id": "South Side"})
    put(tmp_path / "m/b.json", {"contract_id": "local7_north_side", "union_local": "7", "employer": "E", "term_start": "2022", "term_end": "2025", "region_id": "south-side"})
    put(tmp_path / "m/local9_2021_meat_denver.json", {"employer": "F"})
    rows = {r.contract_id: r for r in A.catalog(spark, f"{tmp_path}/m").collect()}
    assert set(rows) == {"local7_north_side", "local9_2021_meat_denver"}
    assert rows["local7_north_side"].contract_version == "2022__2025" and rows["local9_2021_meat_denver"].region_id == "region-denver"
    assert A.default_contract(spark, f"{tmp_path}/m", None, "old") == "local7_north_side"
    assert A.default_contract(spark, f"{tmp_path}/m", None, "local9_2021_meat_denver") == "local9_2021_meat_denver"
    assert A.default_contract(spark, f"{tmp_path}/m", "x", "old") == "x"


def test_pointers(spark, tmp_path):
    for version, at in (("v1", "2024-01-01"), ("v3", "2024-03-01"), ("v2", "2024-02-01")):
        A.write_pointer(spark, f"{tmp_path}/p", "c", version, at)
    assert [(r.contract_id, r.version) for r in A.pointers(spark, f"{tmp_path}/p").collect()] == [("c", "v3")]


def test_uploads_and_packs(spark, tmp_path):
    for name, data in (("a.txt", "naïve".encode()), ("b.md", b"\xef\xbb\xbf# caf\xc3\xa9"), ("c.txt", "naïve".encode("latin-1")), ("d.pdf", b"%PDF"), ("e.xyz", b"?")):
        (tmp_path / name).write_bytes(data)
    put(tmp_path / "p.json", {"contract_id": "c", "articles": [{"article": "1", "title": "T", "sections": [{"section": "2", "title": "S", "text": "words"}]}]})
    got = {r.name: r for r in A.uploads(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].text, got["b.md"].text, got["c.txt"].text) == ("naïve", "# café", "naïve")
    assert (got["d.pdf"].parser, got["d.pdf"].text, got["e.xyz"].parser) == ("external", None, "unsupported")
    assert got["a.txt"].sha256 == hashlib.sha256("naïve".encode()).hexdigest()
    sections = A.pack_sections(A.uploads(spark, str(tmp_path))).collect()
    assert [(s.contract_id, s.article, s.section, s.text) for s in sections] == [("c", "1", "2", "words")]


def test_table_registry(spark, tmp_path):
    heading = lambda t: {"type": "heading", "value": t, "lvl": 1}
    grid = {"type": "table", "rows": [["A", "B"], ["1", "2"]]}
    put(tmp_path / "x.json", {"pages": [{"items": [grid, heading("ARTICLE 3 Pay"), heading("Section 4")]}, {"items": [grid, grid, {"type": "table", "rows": []}, heading("Article 5"), grid]}]})
    got = [(r.table_id, r.article, r.section, r.json_path) for r in A.table_registry(spark, f"{tmp_path}/x.json").orderBy("json_path").collect()]
    assert got == [("tbl_art0_1", None, None, "pages[0].items[0]"), ("tbl_art3_1", "3", "4", "pages[1].items[0]"), ("tbl_art3_2", "3", "4", "pages[1].items[1]"), ("tbl_art5_1", "5", None, "pages[1].items[4]")]


def test_row_sinks(spark):
    rows = [["Name", " Rate "], ['a "b", c', "1", "extra"], ["x", " "]]
    r = spark.createDataFrame([(rows,), ([],)], "rows array<array<string>>").select(A.to_csv(F.col("rows")), A.to_markdown(F.col("rows")), A.to_plaintext(F.col("rows"))).collect()
    assert r[0][0] == 'Name, Rate \n"a ""b"", c",1,extra\nx, '
    assert r[0][1] == '| Name |  Rate  |\n| --- | --- |\n| a "b", c | 1 |\n| x |   |'
    assert r[0][2] == 'Columns: Name | Rate\nName: a "b", c; Rate: 1; Column 3: extra\nName: x'
    assert tuple(r[1]) == ("", "", "")


def test_applicability_and_scope(spark):
    df = spark.createDataFrame([(["a"], "a"), (["b"], "a"), ([], "a"), (None, "a"), (["b"], "")], "allowed array<string>, contract string")
    assert [r[0] for r in df.select(A.applies_to(F.col("allowed"), F.col("contract"))).collect()] == [True, False, True, True, True]
    t = spark.createDataFrame([(1,), (2,), (None,)], "t int")
    assert tenant_scope(t, F.col("t"), None, no_context=True).count() == 3 and tenant_scope(t, F.col("t"), 1, no_context=True).count() == 1


def test_bundle_and_upsert(spark, tmp_path):
    t = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 12, "c")], "tenant int, at int, v string")
    A.export_bundle({"docs": t, "feed": t}, F.col("tenant") == 1, {"feed": ("at", 1)}, f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b/docs").count() == 2 and [r.v for r in spark.read.json(f"{tmp_path}/b/feed").collect()] == ["b"]
    for rows in ([("k", 1), ("k", 2), ("l", 1)], [("l", 5), ("m", 1)], [("l", 5), ("m", 1)]):
        out = A.upsert(spark, spark.createDataFrame(rows, "key string, v int"), f"{tmp_path}/u", "key", [F.desc("v")])
    assert sorted((r.key, r.v) for r in out.collect()) == [("k", 2), ("l", 5), ("m", 1)]


def test_anonymous_keys_are_those_of_hmac(spark):
    rows = [("s", "u", "p"), (None, "u", None), (None, None, None), ('q"\\', "é🙂", "x" * 200)]
    got = spark.createDataFrame(rows, "a string, b string, c string").select(anonymous_key(F.col("a"), F.col("b"), F.col("c"))).collect()
    for (session, union, user), r in zip(rows, got):
        seed = json.dumps({"user_id": user, "union_id": union, "session_id": session}, sort_keys=True)
        want = hmac.new(SECRET.encode(), seed.encode(), hashlib.sha256).hexdigest() if session or union or user else None
        assert r[0] == want
    long = "k" * 100
    assert spark.range(1).select(hmac_sha256(F.lit("text"), long)).first()[0] == hmac.new(long.encode(), b"text", hashlib.sha256).hexdigest()


def test_latest_over_two_batches(spark, tmp_path):
    schema = "key string, at int, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: events.write_latest(events.event_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp", ["key"], "at").awaitTermination()
    write([("a", 1, "old"), ("b", 5, "kept")])
    run()
    write([("a", 2, "new"), ("b", 3, "late"), ("c", 1, "first")])
    run()
    assert sorted((r.key, r.v) for r in events.latest(spark, f"{tmp_path}/out").collect()) == [("a", "new"), ("b", "kept"), ("c", "first")]
