"""Partitioning of DataFrames, and the choice among the ways."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_BYTES, BROADCAST_BYTES = 100 << 20, 10 << 20


def by_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.repartition(n, *columns)


def by_range(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.repartitionByRange(n, *columns)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the estimate is below the limit; beyond it the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def count_for(total_bytes: int, workers: int, target: int = TARGET_BYTES) -> int:
    """About `target` bytes a partition, at most two for each worker, or four beyond 10 GB."""
    most = workers * (4 if total_bytes > 10 << 30 else 2)
    return max(1, min(most, math.ceil(total_bytes / target)))


def choose(join_keys=(), group_keys=(), point=None, range_column=None, size: int = 0) -> str:
    """The way to partition a query's input: by join keys, by group keys, one partition, by range, replicated or in turn."""
    if join_keys:
        return "hash:" + ",".join(join_keys)
    if group_keys:
        return "hash:" + ",".join(group_keys)
    if point:
        return f"hash:{point}"
    if range_column:
        return f"range:{range_column}"
    return "broadcast" if 0 < size <= BROADCAST_BYTES else "round_robin"


def apply(df: DataFrame, strategy: str, n: int) -> DataFrame:
    kind, _, columns = strategy.partition(":")
    if kind == "hash":
        return by_hash(df, n, *columns.split(","))
    if kind == "range":
        return by_range(df, n, columns)
    return F.broadcast(df) if kind == "broadcast" else round_robin(df, n)
