"""Parquet sources: one file, several files of one schema, files behind a URL, and columnar metadata."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FOOTERS_AT_ONCE = 16


class SchemaMismatch(ValueError):
    """Files of one table differ in columns or types."""


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A Parquet scan; column pruning and the limit reach the reader."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def fields(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of all files, which must agree in names, types and order of their columns. Only footers are read to check."""
    if not paths:
        raise ValueError("no files given")
    first = spark.read.parquet(paths[0]).schema
    others = list(dict.fromkeys(paths[1:]))
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        for path, other in zip(others, pool.map(lambda p: spark.read.parquet(p).schema, others)):
            if fields(other) != fields(first):
                raise SchemaMismatch(f"{path}: {fields(other)} differs from {paths[0]}: {fields(first)}")
    return spark.read.schema(first).parquet(*paths)


def schema_differences(existing: T.StructType, new: T.StructType) -> list[str]:
    """What stops `new` from joining a table of schema `existing`: missing columns and changed types. More columns may come."""
    have = {f.name: f.dataType.simpleString() for f in new.fields}
    out = []
    for f in existing.fields:
        if f.name not in have:
            out.append(f"missing column {f.name}")
        elif have[f.name] != f.dataType.simpleString():
            out.append(f"column {f.name}: {f.dataType.simpleString()} became {have[f.name]}")
    return out


def scan_url(spark: SparkSession, url: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet file behind a URL. File systems that Spark knows are read in place; of http(s) files the executors fetch
    their row groups by range requests."""
    if urlparse(url).scheme not in ("http", "https"):
        return scan(spark, url, columns)
    from . import http

    return http.scan(spark, url, columns)


def write(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "snappy", partition_by: list[str] | None = None) -> None:
    """Parquet sink; compression: none, gzip, snappy, zstd or lz4."""
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def column_statistics(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_nulls, min_value, max_value) of every atomic column, in one pass."""
    atomic = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    if not atomic:
        return df.sparkSession.createDataFrame([], "column_name string, n_rows bigint, n_nulls bigint, min_value string, max_value string")
    parts = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value")) for c in atomic]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))
