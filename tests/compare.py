"""Compare a registered query with its SQL twin on the same tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def twin_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return rows_of(columns, cursor.fetchall())


def query_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty when both sides agree, else a short account of the first difference."""
    left_columns, left = query_rows(df)
    right_columns, right = twin_rows(sql, sf_dir)
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            same = x == y
            if isinstance(x, float) and isinstance(y, float):
                same = math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
            if not same:
                return f"{a} != {b}"
    return ""
