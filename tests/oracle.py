"""Compares one Spark result with its SQL on the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return rows_of(cols, cur.fetchall())


def difference(df, con, sql) -> str | None:
    sc, sr = spark_rows(df)
    dc, dr = sql_rows(con, sql)
    if sc != dc:
        return f"columns differ: spark {sc} sql {dc}"
    if sr != dr:
        a, b = set(sr), set(dr)
        return f"rows differ: spark {len(sr)} sql {len(dr)}\n  cols {sc}\n  only spark {sorted(a - b, key=str)[:3]}\n  only sql {sorted(b - a, key=str)[:3]}"
    if not sr:
        return "both results are empty"
    return None
