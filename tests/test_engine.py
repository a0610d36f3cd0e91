"""The engine's statements, name resolution, dialect, cache and output formats on small fixtures."""

import json
import re

import pytest

from strataq.operators.relational import not_in
from strataq.plans import dialect
from strataq.plans.cache import ResultCache
from strataq.plans.engine import Engine
from strataq.sources.catalog import AlreadyExists, Catalog, FileStore, NotFound
from strataq.sources.parquet import SchemaMismatch, scan_files, scan_url
from strataq.sources.registry import TableRegistry

#: fixed values: the fixture rows
EMPLOYEES = [
    (1, "John Doe", "Engineering", 75000.0, 30, "2020-01-15"), (2, "Jane Smith", "Marketing", 65000.0, 28, "2019-03-22"), (3, "Mike Johnson", "Engineering", 80000.0, 35, "2018-07-10"),
    (4, "Sarah Wilson", "HR", 55000.0, 32, "2021-05-18"), (5, "David Brown", "Sales", 70000.0, 29, "2019-11-02"), (6, "Lisa Davis", "Engineering", 85000.0, 33, "2017-12-01"),
    (7, "Tom Miller", "Marketing", 62000.0, 27, "2020-08-14"), (8, "Anna Garcia", "Finance", 68000.0, 31, "2019-06-25"), (9, "Chris Anderson", "Engineering", 78000.0, 34, "2018-04-03"),
    (10, "Maria Rodriguez", "Sales", 72000.0, 26, "2021-02-09"),
]
DEPARTMENTS = [("Engineering", 500000.0), ("Marketing", 200000.0), ("HR", 150000.0), ("Sales", 300000.0), ("Finance", 250000.0), ("Research", 400000.0)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    spark.createDataFrame(EMPLOYEES, "id int, name string, department string, salary double, age int, hire_date string").coalesce(1).write.parquet(f"{folder}/employees.parquet")
    spark.createDataFrame(DEPARTMENTS, "name string, budget double").coalesce(1).write.parquet(f"{folder}/departments.parquet")
    return str(folder)


@pytest.fixture
def engine(spark, data, tmp_path):
    return Engine(spark, data_path=data, catalog=Catalog(spark, warehouse=str(tmp_path)))


def values(engine, sql):
    return [tuple(r) for r in engine.execute(sql).collect()]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT COUNT(*) FROM employees", [(10,)]),
        ("SELECT COUNT(*) FROM employees WHERE salary > 70000", [(5,)]),
        ("SELECT COUNT(*) FROM employees WHERE salary > 80000", [(1,)]),
        ("SELECT AVG(salary) FROM employees WHERE department = 'Engineering'", [(79500.0,)]),
        ("SELECT department, COUNT(*) AS n FROM employees GROUP BY department HAVING COUNT(*) > 1 ORDER BY n DESC, department", [("Engineering", 4), ("Marketing", 2), ("Sales", 2)]),
        ("SELECT d.name FROM departments d LEFT JOIN employees e ON d.name = e.department WHERE e.id IS NULL", [("Research",)]),
        ("SELECT name FROM employees e WHERE salary = (SELECT MAX(salary) FROM employees i WHERE i.department = e.department) ORDER BY name LIMIT 2", [("Anna Garcia",), ("Jane Smith",)]),
        ("SELECT name FROM departments d WHERE NOT EXISTS (SELECT 1 FROM employees e WHERE e.department = d.name)", [("Research",)]),
        ("SELECT COUNT(*) FROM employees WHERE department NOT IN ('HR', 'Sales')", [(7,)]),
        ("SELECT DISTINCT department FROM employees ORDER BY department LIMIT 2 OFFSET 1", [("Finance",), ("HR",)]),
        ("SELECT CONCAT(name, NULL, '!') FROM employees WHERE id = 1", [("John Doe!",)]),
        ("SELECT SUBSTRING('hello', 0, 2), SUBSTRING('hello', 9), SUBSTRING('hello', 2)", [("he", "", "ello")]),
        ("SELECT DATE_PART('year', hire_date), DATE_PART('dow', hire_date), EXTRACT(QUARTER FROM hire_date) FROM employees WHERE id = 1", [(2020, 3, 1)]),
        ("SELECT salary / 0, id % 0, DIVIDE(1, 0), MODULO(7, 4) FROM employees WHERE id = 1", [(None, None, None, 3)]),
        ("SELECT TRIM('\t a '), 'CONCAT(x, NULL)' -- CONCAT(a, b)", [("a", "CONCAT(x, NULL)")]),
        ("SELECT name, CASE WHEN salary > 75000 THEN 'high' ELSE 'low' END AS band FROM employees WHERE id < 4 ORDER BY band, name", [("Mike Johnson", "high"), ("Jane Smith", "low"), ("John Doe", "low")]),
        ("WITH e AS (SELECT * FROM employees WHERE department = 'Sales') SELECT name FROM e UNION SELECT name FROM departments WHERE budget > 450000 ORDER BY name", [("David Brown",), ("Engineering",), ("Maria Rodriguez",)]),
        ("SELECT COUNT(*) FROM read_parquet('employees.parquet') WHERE age < 30", [(4,)]),
    ],
)
def test_queries(engine, sql, expected):
    assert values(engine, sql) == expected


def test_unknown_table_and_syntax_errors(engine):
    for sql in ("SELECT * FROM nowhere", "SELEC 1", "SELECT nothing FROM employees"):
        with pytest.raises(Exception):
            engine.execute(sql).collect()


def test_create_table_forms(engine, data):
    engine.execute("CREATE TABLE rich AS SELECT name, salary FROM employees WHERE salary > 75000")
    assert values(engine, "SELECT COUNT(*) FROM rich") == [(3,)]
    with pytest.raises(AlreadyExists):
        engine.execute("CREATE TABLE rich AS SELECT 1 AS x")
    engine.execute("CREATE TABLE IF NOT EXISTS rich AS SELECT 1 AS x")
    engine.execute("CREATE OR REPLACE TABLE rich AS SELECT name FROM employees WHERE salary > 80000")
    assert values(engine, "SELECT name FROM rich") == [("Lisa Davis",)]
    engine.execute("CREATE TABLE fresh (id int8 NOT NULL, note text, at timestamp)")
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in engine.catalog.schema("fresh").fields] == [("id", "bigint", False), ("note", "string", True), ("at", "timestamp_ntz", True)]
    engine.execute(f"CREATE TABLE d FROM '{data}/departments.parquet'")
    assert values(engine, "SELECT COUNT(*) FROM d") == [(6,)]
    assert values(engine, "SELECT COUNT(*) FROM default.default.d") == [(6,)]


def test_explain(engine):
    text = engine.execute("EXPLAIN SELECT id FROM employees WHERE age = 30").first()[0]
    assert "EqualTo(age,30)" in text
    found = json.loads(engine.execute("EXPLAIN (ANALYZE, FORMAT JSON) SELECT id FROM employees WHERE age > 30").first()[0])
    assert found["actual_rows"] == 5 and found["plan"]
    assert engine.execute("EXPLAIN (FORMAT YAML) SELECT 1").first()[0].startswith("plan:")
    assert "actual_rows: 10" in engine.execute("EXPLAIN ANALYZE SELECT id FROM employees").first()[0]


def test_outputs(engine):
    assert json.loads(engine.execute_to_json("SELECT id, name FROM employees WHERE id = 2")) == [{"id": 2, "name": "Jane Smith"}]
    assert engine.execute_to_table("SELECT id, NULL AS x FROM employees WHERE id = 2") == "id\tx\n2\tNULL"
    assert "rows: 6" in engine.table_info("departments")
    assert engine.statistics("SELECT id FROM employees WHERE id = 2")["pushed_filters"] == 1


def test_cache(engine):
    sql = "SELECT department, COUNT(*) FROM employees GROUP BY department"
    engine.execute(sql).collect(), engine.execute(sql).collect()
    assert engine.cache.stats()["hits"] == 1
    engine.execute("SELECT NOW()"), engine.execute("SELECT NOW()")
    assert engine.cache.stats()["hits"] == 1
    engine.register_http_table("x", "file:///nowhere")
    assert engine.cache.stats()["entries"] == 0


def test_cache_limits(spark):
    cache = ResultCache(seconds=0, most_bytes=10)
    cache.put("a", spark.range(1), 4)
    assert cache.get("a") is None
    cache.seconds = 60
    for k in "abc":
        cache.put(k, spark.range(1), 4)
    assert cache.get("a") is None and cache.get("c") is not None
    cache.put("big", spark.range(1), 11)
    assert cache.get("big") is None


def test_registry(spark, data, tmp_path):
    registry = TableRegistry()
    registry.register("e", f"{data}/employees.parquet")
    registry.register_partitioned("ee", [f"{data}/employees.parquet"] * 2)
    registry.register_with_schema("d", f"{data}/departments.parquet", "name string, budget double")
    registry.register_with_schema("bad", f"{data}/departments.parquet", "name string, budget int")
    registry.save(str(tmp_path / "r.json"))
    again = TableRegistry()
    again.load(str(tmp_path / "r.json"))
    assert again.names() == ["bad", "d", "e", "ee"] and len(again.paths("ee")) == 2
    assert again.read(spark, "ee").count() == 20 and again.read(spark, "d").count() == 6
    with pytest.raises(ValueError):
        again.read(spark, "bad")
    assert again.unregister("e") and "e" not in again


def test_multi_file_schema_check(spark, data, tmp_path):
    with pytest.raises(SchemaMismatch):
        scan_files(spark, [f"{data}/employees.parquet", f"{data}/departments.parquet"])
    assert scan_url(spark, f"file://{data}/departments.parquet").count() == 6


def test_catalog(spark, data, tmp_path):
    store = FileStore(str(tmp_path / "meta.json"))
    catalog = Catalog(spark, store)
    catalog.create_catalog("c")
    catalog.create_schema("c", "s")
    catalog.register("c.s.e", f"{data}/employees.parquet")
    spark.createDataFrame([(11, "New One", "HR", 1.0, 20, "2022-01-01", True)], "id int, name string, department string, salary double, age int, hire_date string, extra boolean").write.parquet(f"{tmp_path}/more.parquet")
    catalog.add_file("c.s.e", f"{tmp_path}/more.parquet")
    assert catalog.read("c.s.e").count() == 11
    assert catalog.statistics("c.s.e")["id"] == {"n_rows": 11, "n_nulls": 0, "min": "1", "max": "11"}
    with pytest.raises(SchemaMismatch):
        catalog.add_file("c.s.e", f"{data}/departments.parquet")
    again = Catalog(spark, FileStore(str(tmp_path / "meta.json")))
    assert again.tables("c.s.*") == ["c.s.e"] and again.files("c.s.e") == catalog.files("c.s.e")
    again.remove_file("c.s.e", f"{tmp_path}/more.parquet")
    assert again.read("c.s.e").count() == 10
    with pytest.raises(ValueError):
        again.drop_schema("c", "s")
    again.drop_table("c.s.e")
    again.drop_schema("c", "s")
    again.drop_catalog("c")
    with pytest.raises(NotFound):
        again.drop_catalog("c")
    with pytest.raises(NotFound):
        again.read("c.s.e")


def test_dialect_leaves_quoted_text_alone():
    assert dialect.rewrite("SELECT 'CONCAT(a)', \"now()\" /* TRIM(x) */") == "SELECT 'CONCAT(a)', \"now()\" /* TRIM(x) */"
    assert dialect.rewrite("concat(upper(concat(a, 'x')), b)") == "concat_ws('', upper(concat_ws('', a, 'x')), b)"


def test_automatic_names():
    names = lambda sql: re.findall(r"AS `([^`]*)`", dialect.named(sql))
    assert names("SELECT COUNT(*), sum(a.x), SUM(x), avg(x) m, min(x) AS z, max(x + 1), x, a.x, a.*, 1, 'COUNT(*)' FROM t a") == ["count", "sum_x", "sum_x_2", "max"]
    assert names("WITH c AS (SELECT count(*) AS n FROM t) SELECT DISTINCT upper(n), n + 1, CASE WHEN n > 1 THEN 2 END, (SELECT max(x) FROM u) FROM c") == ["upper", "expr", "case_expr", "subquery"]
    assert names("SELECT extract(year FROM d), row_number() OVER (ORDER BY x), x IS NULL, x y, -1 FROM t UNION SELECT count(*) FROM u") == ["extract", "row_number", "expr"]
    assert dialect.named("SELECT x FROM t") == "SELECT x FROM t" and dialect.named("VALUES (1)") == "VALUES (1)"


def test_cache_sees_rewritten_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    engine = Engine(spark, data_path=str(tmp_path))
    assert engine.execute("SELECT COUNT(*) FROM t").first()["count"] == 3
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    engine.seen.clear()
    assert engine.execute("SELECT COUNT(*) FROM t").first()["count"] == 8


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    right = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    found = lambda r: sorted((str(x[0]) for x in not_in(left, "x", r, "y").collect()))
    assert found(right(2, 3)) == ["1"] and found(right(2, None)) == [] and found(right()) == ["1", "2", "None"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("not_in")]


def test_scratch_deletes_only_its_own(spark):
    from pathlib import Path

    from strataq import scratch

    folder = Path(scratch.shared_dir(spark).removeprefix("file:"))
    (folder / "others").mkdir(parents=True, exist_ok=True)
    begun = scratch.mark(spark)
    gone, kept = scratch.materialize(spark.range(3), "gone"), scratch.materialize(spark.range(4), "kept")
    places = [Path(df.inputFiles()[0].removeprefix("file:")).parent for df in (gone, kept)]
    scratch.drop_scratch(spark, begun, keep=kept)
    assert [p.exists() for p in places] == [False, True] and (folder / "others").exists() and kept.count() == 4
