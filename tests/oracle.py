"""Compares a query with its SQL in DuckDB: columns, row count and values, whatever the order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


def duck(sf: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in data), key=repr)


def compare(df, sql, sf: str = SF):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck(sf).execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
    return len(got)



