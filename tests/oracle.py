"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def check(con, query, sql: str, spark, sf: str, tmp_path) -> None:
    out = f"{tmp_path}/out"
    query(spark, sf).write.parquet(out)
    a, b = con.sql(sql), con.sql(f"SELECT * FROM '{out}/*.parquet'")
    assert dict(zip(a.columns, map(str, a.types))) == dict(zip(b.columns, map(str, b.types)))
    columns = ", ".join(sorted(a.columns))
    for x, y in ((f"({sql})", f"'{out}/*.parquet'"), (f"'{out}/*.parquet'", f"({sql})")):
        rest = con.sql(f"SELECT {columns} FROM {x} EXCEPT ALL SELECT {columns} FROM {y}").fetchall()
        assert rest == []
