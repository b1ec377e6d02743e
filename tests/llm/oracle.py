"""Runs a query's SQL in DuckDB over the tables of a folder, and compares rows."""

import glob
import os

import duckdb

ROOT = os.environ.get("STATEROLL_TESTDATA", "/root/testdata")
SF = f"{ROOT}/sf0.001"


def rows(sql: str, folder: str = SF) -> list[tuple]:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(r[k] for k in order) for r in got.fetchall()), key=str)


def frame(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
