"""Runs a query and its SQL over the same tables and compares the rows."""

import decimal
import math
import os

import duckdb


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(t):
    names = sorted(t.column_names)
    return names, sorted(repr(tuple(_value(r[c]) for c in names)) for r in t.to_pylist())


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def assert_same(spark, sf_dir, con, query, sql):
    got, want = _rows(query(spark, sf_dir).toArrow()), _rows(con.execute(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
