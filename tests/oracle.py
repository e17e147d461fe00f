"""Comparison of a query's rows with DuckDB's on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def assert_same(frame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want, got = con.execute(sql).fetchdf(), frame.toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))
