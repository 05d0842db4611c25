"""Compares a query with its DuckDB statement."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb

SMALL = "/root/testdata/sf0.001"


def tables(sf_dir: str = SMALL):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.partition('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same(spark, con, query, statement: str, sf_dir: str = SMALL) -> int:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(statement)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert not got - want, list(got - want)[:3]
    assert not want - got, list(want - got)[:3]
    return sum(got.values())
