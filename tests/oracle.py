"""Rows of a query against rows of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x if isinstance(x, (bool, int, str, type(None))) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None, or what differs."""
    got = con.sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} and {sorted(got.columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(got.columns, got.fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows; first differing: {next(((x, y) for x, y in zip(a, b) if x != y), (a[:1], b[:1]))}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    same = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = {n: (kinds[n], str(t)) for n, t in zip(got.columns, got.types) if same.get(kinds[n]) != str(t)}
    return f"types {odd}" if odd else None
