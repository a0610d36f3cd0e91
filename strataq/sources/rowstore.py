"""Numbered tables on disk: a folder with the rows, the tombstones and the declared columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rowindex import ROW, RowIndex
from .parquet import write

#: declared column types: unsigned ones take the next wider signed type
KINDS = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "bool": "boolean", "string": "string", "binary": "binary",
}
COMPRESSIONS = ("none", "gzip", "snappy", "zstd", "lz4")


class RowStore:
    """create, load columns, open, delete, close. Columns are declared first and loaded one by one, joined by row number."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, compression: str = "snappy"):
        if compression not in COMPRESSIONS:
            raise ValueError(f"unknown compression: {compression}")
        self.spark, self.path, self.read_only, self.compression = spark, path.rstrip("/"), read_only, compression
        self.columns: dict[str, tuple[str, bool]] = {}
        self.loaded: dict[str, DataFrame] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, compression: str = "snappy") -> RowStore:
        return cls(spark, path, compression=compression)

    def add_column(self, name: str, kind: str, nullable: bool = True) -> None:
        if name in self.columns or name == ROW:
            raise ValueError(f"column {name} is there already")
        self.columns[name] = (KINDS[kind], nullable)

    def load(self, name: str, data: DataFrame | list[tuple[int, object]]) -> None:
        """(row number, value) pairs of a declared column; a NULL in a column declared without them is an error."""
        kind, nullable = self.columns[name]
        schema = T.StructType([T.StructField(ROW, T.LongType(), False), T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType, True)])
        df = self.spark.createDataFrame(data, schema) if isinstance(data, list) else data.select(F.col(ROW).cast("bigint"), F.col(name).cast(kind))
        if not nullable and not df.filter(F.col(name).isNull()).isEmpty():
            raise ValueError(f"column {name} holds NULLs")
        self.loaded[name] = df

    def close(self) -> RowIndex:
        """Writes the rows (sorted by row number within files, so look-ups prune row groups) and gives their index."""
        if self.read_only:
            return self.index()
        frames = list(self.loaded.values())
        if not frames:
            raise ValueError("no column was loaded")
        df = frames[0]
        for other in frames[1:]:
            df = df.join(other, ROW, "full")
        df = df.select(ROW, *self.loaded).repartitionByRange(ROW).sortWithinPartitions(ROW)
        write(df, f"{self.path}/rows", "overwrite", self.compression)
        write(self.spark.createDataFrame([], f"{ROW} bigint"), f"{self.path}/deleted-{uuid.uuid4().hex}", compression=self.compression)
        return self.index()

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> RowStore:
        store = cls(spark, path, read_only)
        store.columns = {f.name: (f.dataType.simpleString(), f.nullable) for f in spark.read.parquet(f"{store.path}/rows").schema.fields if f.name != ROW}
        return store

    def index(self) -> RowIndex:
        """Rows and all tombstones written so far."""
        gone = self.spark.read.schema(f"{ROW} bigint").parquet(f"{self.path}/deleted-*").distinct()
        return RowIndex(self.spark.read.parquet(f"{self.path}/rows"), gone)

    def delete(self, rows: DataFrame) -> RowIndex:
        """Adds tombstones; rows stay in their files."""
        if self.read_only:
            raise PermissionError(f"{self.path} was opened for reading")
        write(rows.select(ROW), f"{self.path}/deleted-{uuid.uuid4().hex}", compression=self.compression)
        return self.index()
