"""Compares queries with their SQL, run by DuckDB on the same tables."""

import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def same(spark, query, sql):
    """Whether both give the same rows, column by column name."""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = query(spark, FOLDER)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    expect = con.execute(f"SELECT {columns} FROM ({sql})").fetchall()
    got = df.select(*sorted(df.columns)).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(map(plain, r)) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in expect), key=key)
