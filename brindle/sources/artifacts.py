"""Artifacts by path: resolution by priority, manifests, version pointers, uploaded documents, packs, tables; and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import top_per_key


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def resolve(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that exists, in any store that Spark reads."""
    return next((p for p in candidates if exists(spark, p)), None)


def candidates(root: str, kinds: list[str], contract: str | None, version_dir: str | None = None, shared: bool = True) -> list[str]:
    """Paths of an artifact, best first: of the version in force, of the contract (suffix, then prefix form), shared.

    ``kinds``: names from the most to the least enriched, such as chunks_enriched and chunks.
    """
    out = [f"{version_dir}/{k}_{contract}.json" for k in kinds] if contract and version_dir else []
    out += [f"{root}/{k}_{contract}.json" for k in kinds] + [f"{root}/{contract}_{k}.json" for k in kinds] if contract else []
    return out + ([f"{root}/{k}.json" for k in kinds] if shared else [])


# Words of contract ids that name no region.
NO_REGION = ("local", "ufcw", "safeway", "kingsoopers", "clerks", "meat")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def region_id(contract_id: Column, region: Column, location: Column) -> Column:
    """The region that a manifest gives, else its location, else the first telling word of the contract's id."""
    words = F.filter(F.regexp_extract_all(F.lower(contract_id), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.rlike(r"^(\d{4}|local\d+)$") & ~w.isin(*NO_REGION))
    given = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", slug(F.trim(c)))
    bare = slug(contract_id)
    return F.coalesce(given(region), given(location), F.concat(F.lit("region-"), F.get(words, F.lit(0))), F.concat(F.lit("region-"), F.when(bare != "", bare).otherwise("unknown")))


MANIFEST = "contract_id string, union_local string, region_id string, location string, employer string, term_start string, term_end string, contract_version string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per contract of a folder of JSON manifests; of those with the same union, region, employer and term the best id.

    An id that begins with local comes first, then the longer one, then the first in order.
    """
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    cid = F.when(text("contract_id") != "", text("contract_id")).otherwise(F.col("_file"))
    version = F.when(text("contract_version") != "", text("contract_version")).when((text("term_start") != "") & (text("term_end") != ""), F.concat(text("term_start"), F.lit("__"), text("term_end"))).otherwise("")
    rows = raw.select(
        cid.alias("contract_id"), text("union_local").alias("union_local_id"), region_id(cid, F.col("region_id"), F.col("location")).alias("region_id"), version.alias("contract_version"),
        text("employer").alias("employer"), text("term_start").alias("term_start"), text("term_end").alias("term_end"),
    )
    order = [F.lower("contract_id").startswith("local").desc(), F.length("contract_id").desc(), F.col("contract_id")]
    return top_per_key(rows, ["union_local_id", "region_id", "employer", "term_start", "term_end"], order)


def default_contract(spark: SparkSession, path: str, named: str | None, legacy: str) -> str | None:
    """The contract that is named, else the legacy one where it has a manifest, else the first."""
    if named:
        return named
    first = catalog(spark, path).agg(F.min("contract_id").alias("first"), F.max(F.when(F.col("contract_id") == legacy, legacy)).alias("legacy")).first()
    return first["legacy"] or first["first"]


def write_pointer(spark: SparkSession, path: str, contract: str, version: str, at: str) -> None:
    """Appends what is in force from now on; readers take the newest row, so that a write is one atomic file."""
    spark.createDataFrame([(contract, version, at)], "contract_id string, version string, at string").coalesce(1).write.mode("append").parquet(path)


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """The version in force of each contract."""
    return spark.read.parquet(path).groupBy("contract_id").agg(F.max_by("version", F.struct("at", "version")).alias("version"), F.max("at").alias("at"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 without its mark if they are that, else Latin-1."""
    body = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def parser_of(content_type: Column, filename: Column) -> Column:
    """Which parser a file gets: packs, plain texts and markdown here; PDF and images outside; the rest none."""
    kind, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    return (
        F.when((kind == "application/json") | name.endswith(".json"), "contract_pack").when(kind.startswith("text/") | name.rlike(r"\.(txt|md|markdown)$"), "text")
        .when((kind == "application/pdf") | kind.startswith("image/") | name.rlike(r"\.(pdf|png|jpe?g|tiff?)$"), "external").otherwise("unsupported")
    )


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: name, parser, text (of texts and packs), bytes and SHA-256."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    parser = parser_of(F.lit(""), name)
    return raw.select(name.alias("name"), parser.alias("parser"), F.when(parser.isin("text", "contract_pack"), decoded(F.col("content"))).alias("text"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


PACK = "struct<contract_id:string,title:string,articles:array<struct<article:string,title:string,sections:array<struct<section:string,title:string,text:string>>>>>"


def pack_sections(files: DataFrame) -> DataFrame:
    """Sections of uploaded contract packs, in order; a file that is no pack gives none."""
    p = files.filter("parser = 'contract_pack'").select("name", F.from_json("text", PACK).alias("p"))
    a = p.select("name", "p.contract_id", F.posexplode("p.articles").alias("a_no", "a"))
    return a.select("name", "contract_id", "a_no", F.col("a.article").alias("article"), F.col("a.title").alias("article_title"), F.posexplode("a.sections").alias("s_no", "s")).select(
        "name", "contract_id", "article", "article_title", F.col("s.section").alias("section"), F.col("s.title").alias("section_title"), F.col("s.text").alias("text"), "a_no", "s_no"
    )


WALK = "pages array<struct<items:array<struct<type:string,value:string,lvl:int,rows:array<array<string>>>>>>"


def table_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tables of page exports with the article and section of the last headings before them, and an id by article and order."""
    doc = spark.read.schema(WALK).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.posexplode("pages").alias("page", "p"))
    items = doc.select("file", "page", F.posexplode("p.items").alias("item", "i")).select("file", "page", "item", "i.*")
    w = Window.partitionBy("file").orderBy("page", "item").rowsBetween(Window.unboundedPreceding, 0)
    number = lambda word: F.when(F.col("type") == "heading", F.nullif(F.regexp_extract(F.lower("value"), rf"{word}\s+(\d+)", 1), F.lit("")))
    told = items.withColumn("article", F.last(number("article"), True).over(w)).withColumn("_part", F.count(number("article")).over(w))
    within = Window.partitionBy("file", "_part").orderBy("page", "item").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("section", F.last(number("section"), True).over(within)).filter(F.col("type").isin("table", "layout_v2_table") & (F.size("rows") > 0))
    seq = F.row_number().over(Window.partitionBy("file", "article").orderBy("page", "item"))
    return told.select("file", F.concat(F.lit("tbl_art"), F.coalesce("article", F.lit("0")), F.lit("_"), seq.cast("string")).alias("table_id"), "article", "section", "rows", F.format_string("pages[%d].items[%d]", "page", "item").alias("json_path"))


def applies_to(allowed: Column, contract: Column) -> Column:
    """Whether a source document applies: it names the contract among its own, or names none."""
    return (contract == "") | (F.size(F.coalesce(allowed, F.array().cast("array<string>"))) == 0) | F.array_contains(allowed, contract)


def to_csv(rows: Column) -> Column:
    cell = lambda c: F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: cell(F.coalesce(c, F.lit("")))), ",")), "\n")


def to_markdown(rows: Column) -> Column:
    """A table with pipes; rows are filled or cut to the header's width."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    header = F.get(rows, F.lit(0))
    even = lambda r: F.transform(header, lambda _, i: F.coalesce(F.get(r, i), F.lit("")))
    body = F.transform(F.slice(rows, 2, 1_000_000), lambda r: line(even(r)))
    rule = line(F.transform(header, lambda _: F.lit("---")))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(header), rule), body), "\n")).otherwise("")


def to_plaintext(rows: Column) -> Column:
    """A line of columns, then a line per row of labelled cells that aren't blank."""
    header = F.transform(F.get(rows, F.lit(0)), lambda h: F.trim(h))
    label = lambda i: F.when(F.coalesce(F.get(header, i), F.lit("")) != "", F.get(header, i)).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string")))
    cells = lambda r: F.filter(F.transform(r, lambda c, i: F.when(F.trim(c) != "", F.concat(label(i), F.lit(": "), F.trim(c)))), lambda x: x.isNotNull())
    lines = F.filter(F.transform(F.slice(rows, 2, 1_000_000), lambda r: F.array_join(cells(r), "; ")), lambda x: x != "")
    first = F.concat(F.lit("Columns: "), F.array_join(F.filter(header, lambda h: h != ""), " | "))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(first), lines), "\n")).otherwise("")


def export_bundle(tables: dict[str, DataFrame], tenant: Column, newest: dict[str, tuple[str, int]], path: str) -> None:
    """A tenant's rows of each table as JSON; of feeds only the newest rows, as (column, number)."""
    for name, df in tables.items():
        rows = df.filter(tenant)
        if name in newest:
            column, n = newest[name]
            rows = rows.orderBy(F.col(column).desc()).limit(n)
        rows.write.mode("overwrite").json(f"{path}/{name}")


def upsert(spark: SparkSession, fresh: DataFrame, path: str, key: str, order: list[Column]) -> DataFrame:
    """Rows by key in a stored collection: fresh ones, once each, take the place of those of their keys. Written aside, then swapped in."""
    rows = top_per_key(fresh, [key], order)
    if exists(spark, path):
        rows = spark.read.parquet(path).join(rows.select(key), key, "left_anti").unionByName(rows)
    rows.write.mode("overwrite").parquet(f"{path}.next")
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)
    fs.rename(_filesystem(spark, f"{path}.next")[1], where)
    return spark.read.parquet(path)
