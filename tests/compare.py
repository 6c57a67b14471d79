"""Order-blind comparison of a Spark result with a DuckDB one."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from tracklake.fixtures import TABLES

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(plain(x)) for x in v) + "]"
    return str(v)


def connect(data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    spark_rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    duck_rows = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
    assert len(spark_rows) == len(duck_rows)
    assert spark_rows == duck_rows
