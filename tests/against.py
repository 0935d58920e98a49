"""Compares a query's rows with its oracle SQL's, as sets of rows with columns by name."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def by_name(names: list[str], rows: list[tuple]) -> list[list[str]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([repr(row[i]) for i in order] for row in rows)


def assert_same(spark, query, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = query(spark, sf), con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert by_name(got.columns, [tuple(r) for r in got.collect()]) == by_name(names, want.fetchall())
