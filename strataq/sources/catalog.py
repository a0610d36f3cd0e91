"""catalog.schema.table metadata over Parquet files, in memory or in a JSON file."""

from __future__ import annotations

import fnmatch
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .parquet import SchemaMismatch, column_statistics, schema_differences, write


class NotFound(KeyError):
    pass


class AlreadyExists(ValueError):
    pass


class MemoryStore:
    """Metadata as nested dictionaries: catalog -> schema -> table."""

    def __init__(self):
        self.data: dict = {}

    def changed(self) -> None:
        pass


class FileStore(MemoryStore):
    """The same, written to a JSON file at every change."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.data = json.loads(self.path.read_text()) if self.path.exists() else {}

    def changed(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        draft = self.path.with_suffix(".draft")
        draft.write_text(json.dumps(self.data, indent=1))
        draft.replace(self.path)


class Catalog:
    """Catalogs, schemas and tables; a table is a schema and a list of Parquet paths with merged statistics."""

    def __init__(self, spark: SparkSession, store: MemoryStore | None = None, warehouse: str | None = None, catalog: str = "default", schema: str = "default"):
        self.spark, self.store, self.warehouse = spark, store or MemoryStore(), warehouse
        self.current = (catalog, schema)
        self.listeners = []
        self.store.data.setdefault(catalog, {"description": "", "schemas": {}})["schemas"].setdefault(schema, {"description": "", "tables": {}})

    # names

    def parts(self, identifier: str) -> tuple[str, str, str]:
        """One-, two- and three-part names."""
        names = [n.strip("`\"") for n in identifier.split(".")]
        if not 1 <= len(names) <= 3 or not all(names):
            raise ValueError(f"not a table name: {identifier}")
        return tuple([*self.current[: 3 - len(names)], *names])

    def _schema(self, catalog: str, schema: str) -> dict:
        try:
            return self.store.data[catalog]["schemas"][schema]
        except KeyError:
            raise NotFound(f"{catalog}.{schema}") from None

    def _table(self, identifier: str) -> dict:
        catalog, schema, table = self.parts(identifier)
        try:
            return self._schema(catalog, schema)["tables"][table]
        except KeyError:
            raise NotFound(identifier) from None

    def __contains__(self, identifier: str) -> bool:
        try:
            return bool(self._table(identifier))
        except (NotFound, ValueError):
            return False

    def _changed(self, name: str) -> None:
        self.store.changed()
        for f in self.listeners:
            f(name)

    # catalogs and schemas

    def create_catalog(self, name: str, description: str = "") -> None:
        if name in self.store.data:
            raise AlreadyExists(name)
        self.store.data[name] = {"description": description, "schemas": {"default": {"description": "", "tables": {}}}}
        self._changed(name)

    def create_schema(self, catalog: str, name: str, description: str = "") -> None:
        if catalog not in self.store.data:
            raise NotFound(catalog)
        if name in self.store.data[catalog]["schemas"]:
            raise AlreadyExists(f"{catalog}.{name}")
        self.store.data[catalog]["schemas"][name] = {"description": description, "tables": {}}
        self._changed(name)

    def drop_catalog(self, name: str) -> None:
        if self.store.data.pop(name, None) is None:
            raise NotFound(name)
        self._changed(name)

    def drop_schema(self, catalog: str, name: str, cascade: bool = False) -> None:
        if self._schema(catalog, name)["tables"] and not cascade:
            raise ValueError(f"{catalog}.{name} holds tables")
        del self.store.data[catalog]["schemas"][name]
        self._changed(name)

    def catalogs(self) -> list[str]:
        return sorted(self.store.data)

    def schemas(self, catalog: str | None = None) -> list[str]:
        return sorted(self.store.data[catalog or self.current[0]]["schemas"])

    # tables

    def create_table(self, identifier: str, schema: T.StructType | str, paths: list[str] | None = None, replace: bool = False) -> None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        catalog, space, name = self.parts(identifier)
        tables = self._schema(catalog, space)["tables"]
        if name in tables and not replace:
            raise AlreadyExists(identifier)
        tables[name] = {"schema": schema.jsonValue(), "paths": [], "stats": {}}
        for path in paths or []:
            self.add_file(identifier, path)
        self._changed(name)

    def register(self, identifier: str, path: str, replace: bool = False) -> None:
        """A table over an existing file, with the file's schema."""
        self.create_table(identifier, self.spark.read.parquet(path).schema, [path], replace)

    def write_table(self, identifier: str, df: DataFrame, replace: bool = False) -> None:
        """Writes df into the warehouse under a fresh name and registers it."""
        if self.warehouse is None:
            raise ValueError("this catalog has no warehouse folder")
        if identifier in self and not replace:
            raise AlreadyExists(identifier)
        path = f"{self.warehouse.rstrip('/')}/{'.'.join(self.parts(identifier))}-{uuid.uuid4().hex}.parquet"
        write(df, path)
        self.create_table(identifier, df.schema, [path], replace)

    def drop_table(self, identifier: str) -> None:
        catalog, schema, name = self.parts(identifier)
        self._table(identifier)
        del self._schema(catalog, schema)["tables"][name]
        self._changed(name)

    def tables(self, pattern: str = "*") -> list[str]:
        """Full names that match catalog.schema.table, schema.table or table with * and ?."""
        want = ".".join([*self.current[: 3 - len(pattern.split("."))], pattern]) if "." in pattern or pattern != "*" else "*"
        every = (f"{c}.{s}.{t}" for c, x in self.store.data.items() for s, y in x["schemas"].items() for t in y["tables"])
        return sorted(n for n in every if fnmatch.fnmatchcase(n, want))

    def schema(self, identifier: str) -> T.StructType:
        return T.StructType.fromJson(self._table(identifier)["schema"])

    def files(self, identifier: str) -> list[str]:
        return list(self._table(identifier)["paths"])

    def add_file(self, identifier: str, path: str, validate: bool = True) -> None:
        """Adds a file; its columns must include the table's with the same types."""
        table, found = self._table(identifier), self.spark.read.parquet(path)
        if path in table["paths"]:
            raise AlreadyExists(path)
        if validate and (wrong := schema_differences(self.schema(identifier), found.schema)):
            raise SchemaMismatch(f"{path}: {'; '.join(wrong)}")
        table["paths"].append(path)
        table["stats"].pop("columns", None)
        self._changed(identifier)

    def remove_file(self, identifier: str, path: str) -> None:
        table = self._table(identifier)
        if path not in table["paths"]:
            raise NotFound(path)
        table["paths"].remove(path)
        table["stats"].pop("columns", None)
        self._changed(identifier)

    def read(self, identifier: str) -> DataFrame:
        """The rows of all files, with the table's columns."""
        schema, paths = self.schema(identifier), self.files(identifier)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def statistics(self, identifier: str) -> dict:
        """Row count and per-column nulls, minimum and maximum over all files; computed once for each set of files."""
        stats = self._table(identifier)["stats"]
        if "columns" not in stats:
            rows = column_statistics(self.read(identifier)).collect()  # one row for each column
            stats["columns"] = {r.column_name: {"n_rows": r.n_rows, "n_nulls": r.n_nulls, "min": r.min_value, "max": r.max_value} for r in rows}
            self.store.changed()
        return stats["columns"]
