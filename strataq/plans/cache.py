"""Results by exact query text: least recently used out first, with an age limit and a size limit."""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict

from pyspark.sql import DataFrame

MOST_FILES = 1000
VOLATILE = re.compile(r"\b(now|current_date|current_timestamp|rand|randn|uuid|random|shuffle)\b", re.IGNORECASE)


def stamp(df: DataFrame) -> tuple | None:
    """Size and time of every file and folder that a result reads, to notice files rewritten or added; None if they are many."""
    files = df.inputFiles()
    if len(files) > MOST_FILES:
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted({*files, *(f.rpartition("/")[0] for f in files)}):
        path = jvm.org.apache.hadoop.fs.Path(name)
        try:
            status = path.getFileSystem(conf).getFileStatus(path)
        except Exception:  # gone
            return None
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


class ResultCache:
    """Holds results as persisted DataFrames: the rows stay on the executors, only the estimate of their size is kept here."""

    def __init__(self, seconds: float = 300, most_bytes: int = 100 << 20):
        self.seconds, self.most_bytes, self.enabled = seconds, most_bytes, True
        self.entries: OrderedDict[str, tuple[float, int, DataFrame, tuple]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(sql: str) -> str:
        return hashlib.md5(sql.encode(), usedforsecurity=False).hexdigest()

    def get(self, sql: str) -> DataFrame | None:
        key = self.key(sql)
        found = self.entries.get(key)
        if found and (time.time() - found[0] > self.seconds or stamp(found[2]) != found[3]):
            self._drop(key)
            found = None
        if not self.enabled or found is None:
            self.misses += 1
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found[2]

    def put(self, sql: str, df: DataFrame, size: int) -> DataFrame:
        """Remembers df unless the query gives another result each time or the result is too large."""
        if not self.enabled or VOLATILE.search(sql) or size > self.most_bytes or (state := stamp(df)) is None:
            return df
        self.entries[self.key(sql)] = (time.time(), size, df.persist(), state)
        while sum(e[1] for e in self.entries.values()) > self.most_bytes:
            self._drop(next(iter(self.entries)))
        return df

    def _drop(self, key: str) -> None:
        self.entries.pop(key)[2].unpersist()

    def clear(self) -> None:
        for key in list(self.entries):
            self._drop(key)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"entries": len(self.entries), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0, "mb": sum(e[1] for e in self.entries.values()) / (1 << 20)}
