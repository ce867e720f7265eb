"""Run a registered query on Spark and its SQL on DuckDB and compare rows as multisets."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, (float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if got != expected:
        extra = [r for r in got if r not in expected][:3]
        lost = [r for r in expected if r not in got][:3]
        return False, f"{len(got)} != {len(expected)} rows; only spark {extra}; only sql {lost}"
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    off = {n: (types[n], kinds[n]) for n in names if pairs.get(types[n]) != kinds[n].upper()}
    return True, f"{len(got)} rows" + (f" types differ {off}" if off else "")
