"""Merging numbered files: rows, columns by key, and key indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.parquet import SchemaMismatch
from .rowindex import ROW, bit_of, number_rows

FILE = "file_idx"


def _checked(frames: list[DataFrame]) -> None:
    kinds: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            if kinds.setdefault(name, kind) != kind:
                raise SchemaMismatch(f"column {name} is {kinds[name]} and {kind}")


def merge_rows(frames: list[DataFrame], deleted: list[DataFrame] | None = None) -> DataFrame:
    """All rows of all files with the union of their columns, without tombstoned rows; each row keeps file and row number.

    A tombstone names a row number and erases it in every file, as one set for all.
    """
    _checked(frames)
    tagged = [df.withColumn(FILE, F.lit(k)) for k, df in enumerate(frames)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if deleted:
        gone = reduce(lambda a, b: a.unionByName(b), [d.select(ROW) for d in deleted]).distinct()
        out = out.join(gone, ROW, "left_anti")
    return out


def merge_column(frames: list[DataFrame], column: str, distinct: bool = True) -> DataFrame:
    """(row_num, column): one column's values of all files in order, numbered anew. Columns merged this way don't stay
    aligned with each other."""
    _checked(frames)
    values = reduce(lambda a, b: a.unionAll(b), [df.select(column) for df in frames if column in df.columns])
    values = values.filter(F.col(column).isNotNull())
    return number_rows(values.distinct() if distinct else values, column).select(ROW, column)


def merge_keys(frames: list[DataFrame], column: str) -> DataFrame:
    """(key, bucket, bits, n): the key indexes of all files merged, row sets of equal keys united as bitmaps."""
    _checked(frames)
    every = reduce(lambda a, b: a.unionAll(b), [df.select(F.col(column).alias("key"), ROW) for df in frames])
    bucket, bit = bit_of(F.col(ROW))
    bits = every.filter("key IS NOT NULL").groupBy("key", bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"), F.min(ROW).alias("first_row"))
    return bits.select("key", "bucket", "bits", F.bitmap_count("bits").alias("n"), "first_row")


def merge_by_row(frames: list[DataFrame], column: str) -> DataFrame:
    """(row_num, file_idx, column) of all files in row order."""
    tagged = [df.select(ROW, F.lit(k).alias(FILE), column) for k, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), tagged).orderBy(ROW, FILE)


def keep_latest(frames: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the last file that has it (the highest row number there)."""
    merged = merge_rows(frames)
    rest = [c for c in merged.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(FILE, ROW)).alias("_row")
    return merged.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
