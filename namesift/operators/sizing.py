"""Measured sizes, so that a table is broadcast only when it is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
DRIVER_COPIES = 5


def measure(df: DataFrame, text: Column, **extra: Column) -> dict:
    """Row count, text bytes and any extra aggregates of a dictionary-like table, in one job."""
    aggregates = [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"),
        *[column.alias(name) for name, column in extra.items()],
    ]
    return df.agg(*aggregates).first().asDict()


def broadcast_if_small(df: DataFrame, size: dict) -> DataFrame:
    """Hint a broadcast if the measured size allows it; else leave a shuffle join to AQE."""
    if size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def broadcast_or_merge(df: DataFrame, size: dict) -> DataFrame:
    """Hint a broadcast if the measured size is a small share of the bounds; else a sort-merge join.

    For tables beside exploded or well compressed ones. The planner must not choose there: it takes files for sizes,
    which are far smaller than the rows, and what it broadcasts is indexed on the driver at several times its size.
    """
    if DRIVER_COPIES * size["rows"] <= BROADCAST_ROWS and DRIVER_COPIES * size["bytes"] <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("merge")
