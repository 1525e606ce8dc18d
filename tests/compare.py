"""Compare registered queries with their oracles, as sets of rows with columns by name."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, name: str, query, sql: str, con=None) -> list[str]:
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return [f"{name}: columns {sorted(df.columns)} and {sorted(names)}"]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return []
    gs, ws = set(map(repr, got)), set(map(repr, want))
    return [f"{name}: {len(got)} and {len(want)} rows; ours {sorted(gs - ws)[:2]}; theirs {sorted(ws - gs)[:2]}"]
