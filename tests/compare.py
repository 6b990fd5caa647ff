"""Compare a registered query with its SQL, cell by cell after sorting."""

import math

import duckdb

TABLES = ["orders", "customer", "lineitem"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", v + 0.0)
    return v


def _sorted(rows):
    return sorted((tuple(_cell(v) for v in row) for row in rows), key=repr)


SPARK_NAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    """Empty when both give the same columns, types and rows."""
    cur = con.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    names = sorted(df.columns)
    if names != sorted(sql_types):
        return [f"columns {names} against {sorted(sql_types)}"]
    out = [f"type of {c}: {t} against {sql_types[c]}" for c, t in df.dtypes if SPARK_NAME.get(t, t) != sql_types[c]]
    mine = _sorted([tuple(row[c] for c in names) for row in df.collect()])
    order = [list(sql_types).index(c) for c in names]
    theirs = _sorted([tuple(row[i] for i in order) for row in cur.fetchall()])
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} rows against {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first: {bad[0]}")
    return out
