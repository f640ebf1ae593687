"""Comparison of a query with its oracle SQL in DuckDB, as an order-free set of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(float(v[i]), 6)) if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


def expected(sql, sf):
    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    found = db.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def check(df, sql, sf):
    columns, values = expected(sql, sf)
    assert sorted(df.columns) == sorted(columns)
    got = df.collect()
    assert rows(df.columns, got) == rows(columns, values)
