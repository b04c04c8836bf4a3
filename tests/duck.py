"""Run a SQL twin in DuckDB (in process) and compare it with a Spark result."""

from __future__ import annotations

import glob
import math
import os

import duckdb

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def run_sql(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    return dict(zip(names, kinds)), result.fetchall(), names


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found: names, types, row counts and values (exact)."""
    kinds, rows, names = run_sql(con, sql)
    problems = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(set(spark_df.columns) ^ set(names))}"]
    for c, kind in spark_df.dtypes:
        if KINDS.get(kind, kind) != kinds[c]:
            problems.append(f"type of {c}: {kind} against {kinds[c]}")
    order = sorted(names)
    mine = sorted((tuple(_plain(r[c]) for c in order) for r in spark_df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows against {len(theirs)}")
    if mine != theirs:
        have, want = set(mine), set(theirs)
        extra = [m for m in mine if m not in want]
        lacking = [x for x in theirs if x not in have]
        if len(extra) == len(lacking) and extra:
            differing = [(c, a, b) for c, a, b in zip(order, extra[0], lacking[0]) if a != b]
            problems.append(f"{len(extra)} rows differ, first: {differing[:4]}")
        else:
            problems.append(f"rows {extra[:2]} against {lacking[:2]} of {order}")
    return problems
