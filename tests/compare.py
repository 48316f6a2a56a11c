"""Rows of both engines in one form."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.collect())


def duckdb_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    cols = sorted(names)
    return cols, sorted(str([plain(r[names.index(c)]) for c in cols]) for r in result.fetchall())
