"""Holds a Spark query against its DuckDB text on the same tables."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    return v


def both(spark, f, sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    df = f(spark, sf_dir)
    order = sorted(names)
    want = Counter(tuple(plain(row[names.index(n)]) for n in order) for row in r.fetchall())
    got = Counter(tuple(plain(row[n]) for n in order) for row in df.collect()) if sorted(df.columns) == order else df.columns
    return got, want, order
