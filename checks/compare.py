"""Run queries against their SQL twins: ``python -m checks.compare SF [name part ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def normal(value):
    if value is None or (isinstance(value, float) and pd.isna(value)) or value is pd.NaT:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "item"):
        return round(float(value), 9)
    return str(value)


def rows_of(names: list[str], records) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(normal(r[i]) for i in order) for r in records]
    return sorted(names), sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def main() -> int:
    from checks import load

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    parts = sys.argv[2:]
    queries, oracles = load()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from codelode.session import configure

    configure(spark)
    db = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            found = fn(spark, sf_dir)
            names, got = rows_of(found.columns, found.collect())
            took = time.time() - start
            if name not in oracles:
                print(f"ROWS {name} {len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            records = db.execute(oracles[name]).fetchall()
            names2, want = rows_of([d[0] for d in db.description], records)
            took2 = time.time() - start
            if names != names2 or got != want:
                bad += 1
                diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
                print(f"DIFF {name} {len(got)} {len(want)} {names} {names2} {str(diff)[:700]}", flush=True)
            else:
                print(f"OK   {name} {len(got)} {took:.1f}s duck {took2:.1f}s", flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name} {type(error).__name__} {str(error)[:600]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
