"""Run a registered query and its SQL side by side and compare names, types and rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> names the second engine gives the same kind of value.
KINDS = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def compare(con, df, sql: str) -> list[str]:
    """Differences in words; an empty list when the two results are equal."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for column, kind in df.dtypes:
        if kind in KINDS and kinds[column] not in KINDS[kind]:
            problems.append(f"type of {column}: {kind} against {kinds[column]}")
    order = sorted(names)
    want = sorted(tuple(_cell(r[names.index(c)]) for c in order) for r in expected)
    cols = df.columns
    got = sorted(tuple(_cell(r[cols.index(c)]) for c in order) for r in df.collect())
    if len(got) != len(want):
        problems.append(f"{len(got)} rows against {len(want)}")
    if got != want:
        only_got = sorted(set(got) - set(want))[:2]
        only_want = sorted(set(want) - set(got))[:2]
        problems.append(f"rows differ on {order}: {str(only_got)[:600]} against {str(only_want)[:600]}")
    return problems
