"""Compares a query with its DuckDB SQL."""

import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


def same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rel = duck(sf_dir).sql(sql)
    assert sorted(rel.columns) == names
    want = rel.project(", ".join(names)).fetchall()
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    have = [tuple(plain(x) for x in r) for r in got.select(*names).collect()]
    want = [tuple(plain(x) for x in r) for r in want]
    assert sorted(have, key=key) == sorted(want, key=key)
    return len(have)
