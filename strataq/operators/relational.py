"""Relational verbs that Spark has no single call for. Everything else is DataFrame API."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partition import broadcast_if_small

COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def compare(a: Column, op: str, b) -> Column:
    return COMPARE[op](a, b)


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def not_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """NOT IN (subquery) with SQL's NULL rules: an anti join on the subquery's distinct keys, broadcast only where their
    estimated size allows it, and one row that says whether the subquery holds a NULL or nothing at all."""
    keys = other.select(F.col(key).alias("_key"))
    facts = keys.agg((F.count("*") == 0).alias("_none"), (F.count_if(F.col("_key").isNull()) > 0).alias("_null"))
    left = df.join(broadcast_if_small(keys.filter("_key IS NOT NULL").distinct()), F.col(column) == F.col("_key"), "left_anti")
    return left.join(F.broadcast(facts)).filter(F.col("_none") | (~F.col("_null") & F.col(column).isNotNull())).select(*df.columns)  # one row


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Any condition, any join type; hint: broadcast, merge, shuffle_hash or shuffle_replicate_nl."""
    return left.join(right.hint(hint) if hint else right, on, how)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """ORDER BY with LIMIT: one TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def union_chain(frames: list[DataFrame], distinct: bool) -> DataFrame:
    """UNION [ALL] by position; column counts must agree."""
    widths = {len(f.columns) for f in frames}
    if len(widths) != 1:
        raise ValueError(f"each side of a union must have the same number of columns, not {sorted(widths)}")
    out = reduce(lambda a, b: a.unionAll(b), frames)
    return out.distinct() if distinct else out


def sort(df: DataFrame, *keys: tuple[str, str, str] | str) -> DataFrame:
    """keys: a name, or (name, asc or desc, first or last for NULLs). By default NULLs come first ascending, last descending."""
    out = []
    for key in keys:
        name, way, nulls = key if isinstance(key, tuple) else (key, "asc", "first")
        out.append(getattr(F.col(name), f"{way}_nulls_{nulls}")())
    return df.orderBy(*out)
