"""Run a registered query beside its SQL twin and compare the two results."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, build, sql, sf_dir):
    """Returns (spark rows, oracle rows, list of problems)."""
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    elif len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    elif got != want:
        first = next((g, w) for g, w in zip(got, want) if g != w)
        bad = sum(g != w for g, w in zip(got, want))
        problems.append(f"{bad} rows differ, first {first[0]} != {first[1]}")
    elif [[type(v) for v in r] for r in got[:50]] != [[type(v) for v in r] for r in want[:50]]:
        pair = next((g, w) for g, w in zip(got, want) if list(map(type, g)) != list(map(type, w)))
        problems.append(f"types differ: {pair}")
    return got, want, problems
