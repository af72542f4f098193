"""Runs a registered query in Spark and its SQL text in DuckDB and compares the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import re

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def sortable(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


_KIND = [("VARCHAR", "string"), ("BIGINT", "bigint"), ("INTEGER", "int"), ("DOUBLE", "double"),
         ("DATE", "date"), ("BOOLEAN", "boolean"), ("TIMESTAMP", "timestamp_ntz")]


def kind(duck_type: str) -> str:
    for k, v in _KIND:
        if duck_type.upper() == k:
            return v
    return duck_type.lower()


def compare(df, con, sql: str) -> list[str]:
    """Differences found, empty when equal: column names, types, row count, values."""
    problems = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    theirs = cur.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        if s != types[f.name]:
            problems.append(f"type of {f.name}: {s} vs {types[f.name]}")
    order = sorted(names)
    pos = {n: i for i, n in enumerate(names)}
    a = sorted((tuple(norm(r[c]) for c in order) for r in ours), key=sortable)
    b = sorted((tuple(norm(r[pos[c]]) for c in order) for r in theirs), key=sortable)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {order}: {bad[0][0]} vs {bad[0][1]}")
    return problems
