"""Compare a Spark result with the SQL oracle, row for row."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns, types of values and rows."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    theirs = Counter(
        tuple(row[names.index(name)] for name in order) for row in result.fetchall()
    )
    ours = Counter(tuple(row) for row in df.select(*[f"`{name}`" for name in order]).collect())
    if ours == theirs:
        return ""
    only_ours, only_theirs = ours - theirs, theirs - ours
    return (
        f"{ours.total()} rows against {theirs.total()}; only ours {only_ours.total()}: "
        f"{str(list(only_ours)[:2])[:500]}; only theirs: {str(list(only_theirs)[:2])[:500]}"
    )
