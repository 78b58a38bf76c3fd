"""Comparison of a query with its SQL on the same tables."""

import datetime
import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in os.listdir(folder):
        con.execute(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(dict(zip(columns, row))[c]) for c in names) for row in out.fetchall()), key=repr)
    assert got == want
