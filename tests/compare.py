"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb


def connect(data: str):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


def _cell(x) -> str:
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(_cell(r[i]) for i in order) for r in result.fetchall())


def check(spark, data: str, registry, name: str) -> None:
    df = registry.QUERIES[name](spark, data)
    if name not in registry.ORACLE_SQL:
        df.write.format("noop").mode("overwrite").save()
        return
    names, wanted = sql_rows(connect(data), registry.ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == wanted
