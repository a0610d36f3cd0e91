"""Packed request and answer tables: sorted 64-bit keys and their columns as compressed byte planes.

A block asks at the bucket that owns a range of keys; the bucket answers in the block's own order. One entry stands for a
key however often the block has it, so no key is hot.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .scratch import fresh_path, remember_table

BUCKET_BYTES, UNKNOWN, MOST_TIMES, MOST_BUCKETS = 128 << 20, 1 << 60, 16, 100_000  # the last is Spark's own limit


def squeeze(a: np.ndarray) -> bytes:
    """An integer or float array as compressed byte planes."""
    import zstandard

    width = a.dtype.itemsize
    head = bytes([ord(a.dtype.kind), width])
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.copy() if len(a) else np.empty(0, np.uint8)
    return head + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def swell(data: bytes) -> np.ndarray:
    import zstandard

    kind, width = chr(data[0]), data[1]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<{kind}{width}").ravel() if len(raw) else np.empty(0, f"<{kind}{width}")


def narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in the least width that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def pack_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(swell(data), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of hashes, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def requests(block: int, keys: np.ndarray, columns: list[np.ndarray], buckets: int) -> list[dict]:
    """Request rows for sorted keys and their columns."""
    own = bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        out.append({"bucket": int(own[a]), "block": block, "keys": pack_sorted(keys[a:b]), "counts": framed([squeeze(c[a:b]) for c in columns])})
    return out


def framed(parts: list[bytes]) -> bytes:
    """Parts behind their sizes."""
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def columns_of(data: bytes, n: int) -> list[np.ndarray]:
    sizes = np.frombuffer(data[: 4 * n], "<u4")
    ends = 4 * n + np.cumsum(sizes)
    return [swell(data[e - s : e]) for s, e in zip(sizes, ends)]


def release() -> None:
    """Gives freed memory back to the system; allocators otherwise keep it for the life of a Python worker."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def to_table(rows: list[dict], ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    return pa.table([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def bucketed(df: DataFrame, name: str, key: str, size: int = 0) -> DataFrame:
    """Writes df bucketed by key, so that cogrouping it by key moves none of it.

    Buckets grow in number with the input's estimated size, up to MOST_TIMES the shuffle partitions; a size that the optimizer
    doesn't know (it then says a number beyond UNKNOWN) counts as none.
    """
    spark = df.sparkSession
    table = f"strataq_{name}_{uuid.uuid4().hex}"
    remember_table(spark, table)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size < UNKNOWN:
        n = max(n, min(MOST_BUCKETS, MOST_TIMES * n, -(-size // BUCKET_BYTES)))
    df.write.bucketBy(n, key).option("path", fresh_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession):
    """Queries run within delete their shuffle files when they end; otherwise these stay until the driver collects garbage.

    It is a setting of the session, so it holds for what other threads start there meanwhile: a DataFrame of theirs that is
    run again then writes its shuffle files again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """A model table, partitioned by kind."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
