"""The SQL entry point: name resolution, statements beyond SELECT, result cache, EXPLAIN, output formats."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.catalog import AlreadyExists, Catalog
from ..sources.parquet import scan_files, scan_url
from ..sources.registry import TableRegistry
from ..trace import Tracer
from . import dialect
from .cache import ResultCache
from .stats import plan_statistics

CREATE = re.compile(r"\s*CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`\"]+)\s*(.*)", re.IGNORECASE | re.DOTALL)
EXPLAIN = re.compile(r"\s*EXPLAIN\s*(\([^)]*\))?((?:\s+(?:ANALYZE|VERBOSE|COSTS))*)\s+((?:SELECT|WITH|FROM|VALUES|\().*)", re.IGNORECASE | re.DOTALL)


class Engine:
    """execute(sql) gives a DataFrame; tables are found by name when a query needs them.

    Order of resolution: opened DataFrames, URLs, the catalog, the registry, <data_path>/<table>.parquet. Each engine has
    a session of its own, so two engines' tables don't mix. Division by zero gives NULL in SQL text (ansi=False);
    ansi=True makes it an error.
    """

    def __init__(self, spark: SparkSession, data_path: str | None = None, catalog: Catalog | None = None, registry: TableRegistry | None = None, cache: ResultCache | None = None, ansi: bool = False):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", str(ansi).lower())
        self.data_path, self.catalog, self.registry = data_path, catalog, registry or TableRegistry()
        self.cache, self.trace = cache or ResultCache(), Tracer()
        self.opened: dict[str, DataFrame] = {}
        self.urls: dict[str, str] = {}
        self.seen: set[str] = set()
        if catalog is not None:
            catalog.spark = self.spark
            catalog.listeners.append(self.table_changed)

    # tables

    def open(self, name: str, df: DataFrame) -> None:
        """A DataFrame under a name; one of another session is taken over by its plan."""
        self.opened[name] = df if df.sparkSession is self.spark else DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan()), self.spark)
        self.table_changed(name)

    def register_http_table(self, name: str, url: str) -> None:
        self.urls[name] = url
        self.table_changed(name)

    def unregister_http_table(self, name: str) -> bool:
        self.table_changed(name)
        return self.urls.pop(name, None) is not None

    def table_changed(self, name: str) -> None:
        """Forgets results and the view of a changed table."""
        self.cache.clear()
        for view in list(self.seen):
            self.spark.catalog.dropTempView(view)
        self.seen.clear()

    def table(self, name: str) -> DataFrame:
        if name in self.opened:
            return self.opened[name]
        if name in self.urls:
            return scan_url(self.spark, self.urls[name])
        if self.catalog is not None and name in self.catalog:
            return self.catalog.read(name)
        if name in self.registry:
            return self.registry.read(self.spark, name)
        if self.data_path and "." not in name:
            return scan_files(self.spark, [f"{self.data_path}/{name}.parquet"])
        raise KeyError(f"no table {name}")

    def _parquet_path(self, args: list[str]) -> str:
        path = args[0].strip().strip("'")
        if not re.match(r"/|\w+://|\w+:/", path) and self.data_path:
            path = f"{self.data_path}/{path}"
        return f"parquet.`{path}`"

    def _rewritten(self, sql: str) -> str:
        return dialect.rewrite(dialect.named(sql), dialect.CALLS | {"read_parquet": self._parquet_path})

    def relations(self, sql: str) -> list[str]:
        """The names that a query reads, as Spark's parser sees them, without those of its own WITH clauses."""
        tree = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
        own = {n.strip() for group in re.findall(r"CTE \[([^\]]*)\]", tree) for n in group.split(",")}
        found = dict.fromkeys(".".join(p.strip() for p in m.split(",")) for m in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree))
        return [n for n in found if n not in own]

    def _select(self, sql: str) -> DataFrame:
        """Analyzes a query after giving each table that it reads a view; qualified names get views of one-part names."""
        text = self._rewritten(sql).strip().rstrip(";")
        for name in self.relations(text):
            view = name.replace(".", "__")
            if view not in self.seen:
                try:
                    self.table(name).createOrReplaceTempView(view)
                except KeyError:
                    continue  # perhaps a table of Spark's own catalog; if not, analysis says so
                self.seen.add(view)
            if view != name:
                text = re.sub(r"(?<![\w.`])" + r"\s*\.\s*".join(f"`?{re.escape(p)}`?" for p in name.split(".")) + r"(?![\w`])", view, text)
        return self.spark.sql(text)

    # statements

    def execute(self, sql: str) -> DataFrame:
        """SELECT and set operations, CREATE TABLE in its four forms, EXPLAIN."""
        self.trace.log("QUERY", "INFO", "execute", sql=sql)
        if m := EXPLAIN.fullmatch(sql):
            return self.explain(m[3], f"{m[1] or ''} {m[2] or ''}")
        if m := CREATE.fullmatch(sql.strip().rstrip(";")):
            return self._create(bool(m[1]), bool(m[2]), m[3].strip("`\""), m[4].strip())
        if (found := self.cache.get(sql)) is not None:
            return found
        df = self._select(sql)
        return self.cache.put(sql, df, plan_statistics(df)["estimated_bytes"])

    def _create(self, replace: bool, if_missing: bool, name: str, rest: str) -> DataFrame:
        if self.catalog is None:
            raise ValueError("CREATE TABLE needs a catalog")
        if name in self.catalog and not replace:
            if if_missing:
                return self._said(f"table {name} exists")
            raise AlreadyExists(name)
        if m := re.fullmatch(r"FROM\s+'([^']+)'", rest, re.IGNORECASE):
            self.catalog.register(name, m[1], replace)
        elif m := re.fullmatch(r"AS\s+(.*)", rest, re.IGNORECASE | re.DOTALL):
            self.catalog.write_table(name, self._select(m[1]), replace)
        elif m := re.fullmatch(r"\((.*)\)", rest, re.DOTALL):
            self.catalog.create_table(name, T.StructType.fromDDL(dialect.column_ddl(m[1])), replace=replace)
        else:
            raise ValueError(f"not a CREATE TABLE: {rest[:80]}")
        return self._said(f"table {name} created")

    def _said(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    def explain(self, sql: str, options: str = "") -> DataFrame:
        """One column `plan`. Options: ANALYZE (runs the query, adds rows and time), VERBOSE, COSTS, FORMAT TEXT|JSON|YAML."""
        options = options.upper()
        df = self._select(sql)
        q = df._jdf.queryExecution()
        facts: dict = {}
        if "ANALYZE" in options:
            began = time.time()
            facts = {"actual_rows": df.count(), "actual_ms": round((time.time() - began) * 1000, 3)}
        mode = "extended" if "VERBOSE" in options else "cost" if "COSTS" in options else "formatted"
        if "JSON" in options:
            text = json.dumps({"plan": json.loads(q.optimizedPlan().toJSON()), **facts, **plan_statistics(df)})
        else:
            jvm_mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
            text = q.explainString(jvm_mode) + "".join(f"\n{k}: {v}" for k, v in facts.items())
            if "YAML" in options:
                text = "plan: |\n" + "\n".join(f"  {line}" for line in text.splitlines())
        return self.spark.createDataFrame([(text,)], "plan string")

    # output

    def execute_to_json(self, sql: str) -> str:
        """The whole result as a JSON array (for results that fit the caller)."""
        return json.dumps([json.loads(x) for x in self.execute(sql).toJSON().collect()])

    def execute_to_table(self, sql: str) -> str:
        """The whole result as tab-separated text with a header."""
        df = self.execute(sql)
        rows = [["NULL" if v is None else str(v) for v in r] for r in df.collect()]
        return "\n".join("\t".join(r) for r in [df.columns, *rows])

    def table_info(self, name: str) -> str:
        df = self.table(name)
        return "\n".join([f"table: {name}", f"rows: {df.count()}", *(f"  {f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields)])

    def statistics(self, sql: str) -> dict:
        return plan_statistics(self._select(sql))
