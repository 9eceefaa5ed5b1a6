"""Compares a query's rows with its SQL's on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert names == sorted(df.columns)
    want = Counter(tuple(plain(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect())
    assert got == want, f"{sum((got - want).values())} rows too many, {sum((want - got).values())} too few; e.g. {list((got - want).items())[:2]} {list((want - got).items())[:2]}"
