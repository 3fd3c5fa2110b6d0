"""Runs queries beside their SQL in DuckDB: python tests/verify.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, dict)) and pd.api.types.is_scalar(v) and pd.isna(v)):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy" or type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        try:
            began = time.time()
            got = queries[name](spark, sf_dir)
            schema = {f.name: f.dataType.simpleString() for f in got.schema}
            got = normal(got.toPandas())
            took = time.time() - began
            if name not in sql:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            want = con.execute(sql[name]).df()
            same_names = sorted(want.columns) == sorted(schema)
            want = normal(want)
            ok = same_names and got == want
            bad += not ok
            print(f"{'ok  ' if ok else 'BAD '} {name} {len(got)} {len(want)} {took:.1f}s", flush=True)
            if not ok:
                print("   columns", sorted(schema), same_names)
                a, b = set(got), set(want)
                print("   spark only", sorted(a - b)[:3], "\n   sql only", sorted(b - a)[:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
