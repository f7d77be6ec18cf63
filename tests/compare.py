"""Order-free comparison of a Spark result with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return repr(int(x)) if x.is_integer() else repr(round(x, 9)) if not math.isnan(x) else "nan"
    return str(x)


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Message about the first difference, or ``None``."""
    ref = con.execute(sql)
    names = [d[0] for d in ref.description]
    want = canon(names, ref.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = canon(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
