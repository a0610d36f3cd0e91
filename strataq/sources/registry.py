"""A registry of table names: files, partition lists and declared schemas, kept in JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .parquet import scan_files, schema_differences


@dataclass
class Entry:
    name: str
    paths: list[str]
    schema_ddl: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


class TableRegistry:
    def __init__(self):
        self._entries: dict[str, Entry] = {}

    def register(self, name: str, path: str) -> None:
        self._put(Entry(name, [path]))

    def register_with_schema(self, name: str, path: str, schema_ddl: str, **properties: str) -> None:
        T.StructType.fromDDL(schema_ddl)  # fails early on a wrong schema
        self._put(Entry(name, [path], schema_ddl, properties))

    def register_partitioned(self, name: str, paths: list[str]) -> None:
        if not paths:
            raise ValueError("a partitioned table needs a path")
        self._put(Entry(name, list(paths)))

    def _put(self, entry: Entry) -> None:
        if not entry.name:
            raise ValueError("a table needs a name")
        self._entries[entry.name] = entry

    def unregister(self, name: str) -> bool:
        return self._entries.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._entries)

    def paths(self, name: str) -> list[str]:
        """All partitions of a table."""
        return list(self._entries[name].paths)

    def __contains__(self, name: str) -> bool:
        return name in self._entries

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        entry = self._entries[name]
        df = scan_files(spark, entry.paths)
        if entry.schema_ddl and (wrong := schema_differences(T.StructType.fromDDL(entry.schema_ddl), df.schema)):
            raise ValueError(f"{name}: {'; '.join(wrong)}")
        return df

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"tables": [asdict(e) for e in self._entries.values()]}, indent=2))

    def load(self, path: str) -> None:
        for e in json.loads(Path(path).read_text())["tables"]:
            self._put(Entry(**e))
