"""Run catalog queries against their SQL and report differences."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 6) + 0.0
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both sides give the same columns and rows, else what differs first."""
    relation = db.sql(sql)
    if sorted(spark_df.columns) != sorted(relation.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(relation.columns)}"
    ours = _rows(spark_df.columns, spark_df.collect())
    theirs = _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other:
            return f"{str(mine)[:600]} and {str(other)[:600]}"
    return None
