"""Parquet files behind http(s): the driver reads the footer, tasks fetch their row groups by range requests."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession

from ..scratch import ship

AHEAD = 1 << 20


class RangeFile(io.RawIOBase):
    """A seekable file over a URL; every read is a range request of AHEAD bytes or more, the last one is remembered."""

    def __init__(self, url: str, seconds: float = 60):
        import urllib.request

        self.url, self.seconds, self.at = url, seconds, 0
        self.first, self.held = 0, b""
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=seconds) as answer:
            self.size = int(answer.headers["Content-Length"])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def _fetch(self, first: int, last: int) -> None:
        import urllib.request

        ask = urllib.request.Request(self.url, headers={"Range": f"bytes={first}-{last - 1}"})
        with urllib.request.urlopen(ask, timeout=self.seconds) as answer:
            self.held = answer.read()
            self.first = first if answer.status == 206 else 0  # a server without ranges sends all

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.at + n, self.size)
        if end <= self.at:
            return b""
        if not (self.first <= self.at and end <= self.first + len(self.held)):
            self._fetch(self.at, min(max(end, self.at + AHEAD), self.size))
        out = self.held[self.at - self.first : end - self.first]
        self.at += len(out)
        return out

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def scan(spark: SparkSession, url: str, columns: list[str] | None = None) -> DataFrame:
    """The file's rows, one task for each row group; only the columns asked for are fetched."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    ship(spark)
    file = pq.ParquetFile(RangeFile(url))
    whole = from_arrow_schema(file.schema_arrow)
    kinds = type(whole)([whole[c] for c in columns]) if columns else whole
    names, groups = [f.name for f in kinds], file.metadata.num_row_groups

    def fetch(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kinds)
        for batch in batches:
            mine = batch.column(0).to_pylist()
            if mine:
                source = pq.ParquetFile(RangeFile(url))
                for found in source.iter_batches(row_groups=mine, columns=names):
                    yield pa.Table.from_batches([found]).select(names).cast(target).combine_chunks().to_batches()[0]

    return spark.range(0, groups, 1, max(1, groups)).mapInArrow(fetch, kinds)
