"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr), [columns[k] for k in order]


def both(spark, query, sql, sf_dir=SF_DIR):
    import duckdb

    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    return got, want
