"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: object) -> object:
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 9) if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> None:
    got = query(spark, sf_dir)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.sql(sql)
        columns, expected = want.columns, want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, expected)
