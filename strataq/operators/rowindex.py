"""A predicate interface over numbered rows: every query gives the row numbers that satisfy it.

Rows carry a row_num assigned once at load. Conditions stay Column expressions until asked for, so and/or/not of any
number of them are one scan with pushed-down filters, not set operations over row sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

ROW = "row_num"
NULLS_FIRST, NULLS_LAST = "first", "last"


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """df with row_num from 0 in the order given; rows that the order doesn't tell apart are numbered in any order.

    One plan and one shuffle: rows are dealt into ranges (equal keys spread by their place in the input, so no key is hot),
    sorted, and written once with their range and their place in it. Sums of the written ranges' sizes (one row a range) make
    the numbers, so every later read gives a row the same number at any width and on any number of cores.
    """
    if ROW in df.columns:
        raise ValueError(f"{ROW} is there already")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # the id's upper bits are the range, its lower 33 bits the place in it
    held = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    sizes = held.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(sizes.select("_range", before.alias("_before")))  # at most one row for each of n ranges
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(shift, "_range").select(*df.columns, number.alias(ROW))


def bit_of(row: Column) -> tuple[Column, Column]:
    """(bitmap's number from 1, bit in it) of a row number; Spark counts bits from one."""
    return F.bitmap_bucket_number(row + 1), F.bitmap_bit_position(row + 1)


class RowIndex:
    """Predicates, look-ups, ordered iteration, statistics and tombstones over df, which has row_num."""

    BUCKET = 32_768  # rows in a bitmap, as Spark's bitmap functions count them

    def __init__(self, df: DataFrame, deleted: DataFrame | None = None):
        if ROW not in df.columns:
            raise ValueError(f"a row index needs {ROW}")
        self.df = df
        self.deleted = deleted if deleted is not None else df.select(ROW).filter("false")

    # conditions

    def eq(self, column: str, value) -> Column:
        return F.col(column) == F.lit(value)

    def between(self, column: str, low, high, nulls: str | None = None) -> Column:
        """Inclusive; NULLs belong to the range only if nulls says on which side they sort and that side is open (None)."""
        out = F.lit(True)
        if low is not None:
            out = out & (F.col(column) >= F.lit(low))
        if high is not None:
            out = out & (F.col(column) <= F.lit(high))
        if (nulls == NULLS_FIRST and low is None) or (nulls == NULLS_LAST and high is None):
            out = out | F.col(column).isNull()
        return out

    def less(self, column: str, value, or_equal: bool = False, nulls: str | None = None) -> Column:
        out = F.col(column) <= F.lit(value) if or_equal else F.col(column) < F.lit(value)
        return out | F.col(column).isNull() if nulls == NULLS_FIRST else out

    def greater(self, column: str, value, or_equal: bool = False, nulls: str | None = None) -> Column:
        out = F.col(column) >= F.lit(value) if or_equal else F.col(column) > F.lit(value)
        return out | F.col(column).isNull() if nulls == NULLS_LAST else out

    def is_null(self, column: str) -> Column:
        return F.col(column).isNull()

    def not_null(self, column: str) -> Column:
        return F.col(column).isNotNull()

    def all_of(self, *conditions: Column | None) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out if c is None else out & c
        return out

    def any_of(self, *conditions: Column | None) -> Column:
        out = F.lit(False)
        for c in conditions:
            out = out if c is None else out | c
        return out

    def none_of(self, column: str, condition: Column) -> Column:
        """The rows with a value in `column` that don't satisfy the condition."""
        return F.col(column).isNotNull() & ~F.coalesce(condition, F.lit(False))

    # row sets

    def rows(self, condition: Column, live: bool = False) -> DataFrame:
        """row_num of the rows that satisfy the condition; live: without the deleted ones."""
        out = self.df.filter(condition).select(ROW)
        return out.join(self.deleted, ROW, "left_anti") if live else out

    def cardinality(self, condition: Column) -> int:
        return self.df.filter(condition).count()

    @staticmethod
    def bitmap(rows: DataFrame) -> DataFrame:
        """(bucket, bits): the row set as compressed bitmaps of fixed size, built with partial aggregation."""
        bucket, bit = bit_of(F.col(ROW))
        return rows.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))

    @staticmethod
    def union_bitmaps(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    @staticmethod
    def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
        return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))

    @staticmethod
    def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, ROW, "left_semi")

    @staticmethod
    def union(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).distinct()

    # look-ups and iteration

    def lookup(self, row: int, *columns: str) -> DataFrame:
        return self.df.filter(F.col(ROW) == row).select(*columns) if columns else self.df.filter(F.col(ROW) == row)

    def _bitmaps(self, df: DataFrame, column: str) -> DataFrame:
        """(key, bucket, bits, n, first_row): the row sets of each key as bitmaps of fixed size, so no key's rows meet in one row."""
        bucket, bit = bit_of(F.col(ROW))
        return df.groupBy(F.col(column).alias("key"), bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"), F.count("*").alias("n"), F.min(ROW).alias("first_row"))

    def keys(self, column: str, descending: bool = False, low=None, high=None) -> DataFrame:
        """(key, bucket, bits, n, first_row): each distinct non-null key in order with its row numbers in bitmaps."""
        order = F.col("key").desc() if descending else F.col("key").asc()
        return self._bitmaps(self.df.filter(F.col(column).isNotNull() & self.between(column, low, high)), column).orderBy(order, "bucket")

    @staticmethod
    def key_counts(bitmaps: DataFrame) -> DataFrame:
        """(key, n, first_row) of what `keys` or `seek` gives."""
        return bitmaps.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))

    @staticmethod
    def rows_of(bitmaps: DataFrame) -> DataFrame:
        """(key, row_num): the rows in bitmaps, one by one."""
        per, width = RowIndex.BUCKET, RowIndex.BUCKET // 8
        byte = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("byte")
        bits = bitmaps.select("key", "bucket", "bits", byte).withColumn("value", F.conv(F.hex(F.expr("substring(bits, byte + 1, 1)")), 16, 10).cast("int")).filter("value > 0")
        each = bits.select("key", "bucket", "byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).filter("value & shiftleft(1, bit) > 0")
        number = (F.col("bucket") - 1) * per + F.col("byte") * 8 + F.col("bit")
        return each.select("key", number.cast("bigint").alias(ROW))

    def seek(self, column: str, value, forward: bool = True) -> DataFrame:
        """The first key at or after value (or at or before it), with its rows: a filtered minimum and an equality scan."""
        bound = self.df.filter(self.greater(column, value, True) if forward else self.less(column, value, True))
        key = bound.agg((F.min if forward else F.max)(column).alias("_key")).filter("_key IS NOT NULL")
        return self._bitmaps(self.df.join(F.broadcast(key), F.col(column) == F.col("_key")), column)  # one row

    def find(self, column: str, value) -> DataFrame:
        """row_num of one key: a pushed-down equality."""
        return self.rows(self.eq(column, value))

    def range_search(self, column: str, low, high) -> DataFrame:
        """(key, row_num) of keys from low to high, both included, in order of key and row."""
        return self.df.filter(self.between(column, low, high) & F.col(column).isNotNull()).select(F.col(column).alias("key"), ROW).orderBy("key", ROW)

    @staticmethod
    def bulk_load(pairs: DataFrame, path: str, key: str = "key") -> RowIndex:
        """Writes (key, row_num) pairs in key order, so that find and range_search read only the row groups of their keys."""
        pairs.select(key, ROW).repartitionByRange(key, ROW).sortWithinPartitions(key, ROW).write.parquet(path)
        return RowIndex(pairs.sparkSession.read.parquet(path))

    def fetch(self, rows: DataFrame) -> DataFrame:
        """The rows of a row set."""
        return self.df.join(rows, ROW, "left_semi")

    def stats(self, column: str) -> DataFrame:
        c = F.col(column)
        return self.df.agg(F.count("*").alias("n_rows"), F.count_distinct(c).alias("n_distinct"), F.count_if(c.isNull()).alias("n_nulls"), F.min(c).alias("min_value"), F.max(c).alias("max_value"))

    # tombstones

    def delete(self, rows: DataFrame) -> RowIndex:
        return RowIndex(self.df, self.deleted.unionByName(rows.select(ROW)).distinct())

    def undelete(self, rows: DataFrame) -> RowIndex:
        return RowIndex(self.df, self.deleted.join(rows, ROW, "left_anti"))

    def live(self) -> DataFrame:
        return self.df.join(self.deleted, ROW, "left_anti")
