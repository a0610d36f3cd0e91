"""Registered queries and the SQL each one is checked against.

Queries are DataFrame plans over the driver's tables; the ids in the names' comments are those of the operator inventory.
Sums of money count whole cents so that their value doesn't depend on the order of rows.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import merge, partition
from ..operators import relational as rel
from ..operators.rowindex import NULLS_FIRST, NULLS_LAST, RowIndex, number_rows
from ..scratch import fresh_path
from ..sources import parquet
from ..sources.catalog import AlreadyExists, Catalog
from ..sources.parquet import SchemaMismatch
from ..sources.registry import TableRegistry
from ..sources.rowstore import RowStore
from . import stats
from .engine import Engine

_queries: dict = {}
_oracles: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    """The sum of amounts of two decimals, in whole cents."""
    return F.sum(F.floor(F.col(c) * 100 + 0.5)) / 100


M = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
LINE = ["l_orderkey", "l_linenumber"]

# --- scans and projections -------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_pruned_columns(spark, sf_dir):  # S1 S2 P1 P2
    return parquet.scan(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name", "c_acctbal"])


@query("SELECT * FROM supplier")
def scan_all_columns(spark, sf_dir):  # S1 S19
    return parquet.scan(spark, f"{sf_dir}/supplier.parquet")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_with_limit(spark, sf_dir):  # S3 K3
    return rel.top_k(parquet.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"]), 100, F.col("o_orderkey").asc())


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_multi_file(spark, sf_dir):  # S5
    return parquet.scan_files(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet"]).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_regionkey, r_name FROM region")
def scan_url(spark, sf_dir):  # S4; tests/test_http.py reads over http
    return parquet.scan_url(spark, f"{sf_dir}/region.parquet", ["r_regionkey", "r_name"])


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def scan_table_function(spark, sf_dir):  # S6
    return Engine(spark, data_path=sf_dir).execute("SELECT n_name, n_regionkey FROM read_parquet('nation.parquet') WHERE n_regionkey = 2")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def engine_name_resolution(spark, sf_dir):  # S7
    return Engine(spark, data_path=sf_dir).execute("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def registry_partitioned_table(spark, sf_dir):  # S8
    registry = TableRegistry()
    registry.register_partitioned("nations", [f"{sf_dir}/nation.parquet"] * 2)
    return Engine(spark, registry=registry).execute("SELECT n_nationkey, n_name FROM nations")


@query("SELECT r_regionkey, r_name FROM region")
def catalog_three_part_name(spark, sf_dir):  # S9
    catalog = Catalog(spark)
    catalog.create_catalog("sales")
    catalog.create_schema("sales", "geo")
    catalog.register("sales.geo.region", f"{sf_dir}/region.parquet")
    return Engine(spark, catalog=catalog).execute("SELECT r_regionkey, r_name FROM sales.geo.region")


def _places(spark, sf_dir) -> Catalog:
    """A table whose only file was added, refused twice, removed and added again."""
    catalog = Catalog(spark)
    catalog.create_table("places", "n_nationkey INT, n_name STRING")
    catalog.add_file("places", f"{sf_dir}/nation.parquet")  # more columns than the table's may come
    for wrong, error in ((f"{sf_dir}/region.parquet", SchemaMismatch), (f"{sf_dir}/nation.parquet", AlreadyExists)):
        try:
            catalog.add_file("places", wrong)
        except error:
            continue
        raise AssertionError(f"{wrong} was taken")
    catalog.remove_file("places", f"{sf_dir}/nation.parquet")
    if catalog.read("places").count() or catalog.files("places"):
        raise AssertionError("a removed file is still read")
    catalog.add_file("places", f"{sf_dir}/nation.parquet")
    return catalog


@query("SELECT n_nationkey, n_name FROM nation")
def catalog_add_remove_file(spark, sf_dir):  # S10
    return Engine(spark, catalog=_places(spark, sf_dir)).execute("SELECT n_nationkey, n_name FROM places")


@query("SELECT 'n_nationkey' AS column_name, count(*) AS n_rows, count(*) - count(n_nationkey) AS n_nulls, CAST(min(n_nationkey) AS VARCHAR) AS least, CAST(max(n_nationkey) AS VARCHAR) AS most FROM nation UNION ALL SELECT 'n_name', count(*), count(*) - count(n_name), min(n_name), max(n_name) FROM nation")
def catalog_statistics(spark, sf_dir):  # S10 O4
    found = _places(spark, sf_dir).statistics("places")  # one entry for each column
    return spark.createDataFrame([(c, x["n_rows"], x["n_nulls"], x["min"], x["max"]) for c, x in found.items()], "column_name string, n_rows bigint, n_nulls bigint, least string, most string")


@query(f"SELECT o_custkey, {M.format('o_totalprice')} AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def create_table_as_select(spark, sf_dir):  # S11 S12
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") if not spark.sparkContext.master.partition("[")[0] == "local" else tempfile.mkdtemp(prefix="strataq-")
    engine = Engine(spark, data_path=sf_dir, catalog=Catalog(spark, warehouse=warehouse))
    engine.execute("CREATE TABLE finished AS SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
    return engine.execute("SELECT o_custkey, total FROM finished")


@query("SELECT r_name, CAST(NULL AS INTEGER) AS id, CAST(NULL AS DOUBLE) AS price FROM region")
def create_empty_table(spark, sf_dir):  # S13
    engine = Engine(spark, data_path=sf_dir, catalog=Catalog(spark))
    engine.execute("CREATE TABLE fresh (id int4 NOT NULL, name varchar(20), price float8)")
    return engine.execute("SELECT r_name, f.id, f.price FROM region LEFT JOIN fresh f ON f.name = r_name")


@query("SELECT r_name FROM region")
def create_table_from_file(spark, sf_dir):  # S14
    engine = Engine(spark, catalog=Catalog(spark))
    engine.execute(f"CREATE TABLE places FROM '{sf_dir}/nation.parquet'")
    engine.execute(f"CREATE OR REPLACE TABLE places FROM '{sf_dir}/region.parquet'")
    return engine.execute("SELECT r_name FROM places")


@query("SELECT 1 AS one, 'x' AS x, 2.5::DOUBLE AS f, true AS t, 'AB' AS u")
def constants_without_from(spark, sf_dir):  # S15 P5
    return Engine(spark).execute("SELECT 1 AS one, 'x' AS x, CAST(2.5 AS DOUBLE) AS f, true AS t, UPPER('ab') AS u")


@query("SELECT 'r_regionkey' AS column_name, count(*) AS n_rows, count(*) - count(r_regionkey) AS n_nulls, CAST(min(r_regionkey) AS VARCHAR) AS min_value, CAST(max(r_regionkey) AS VARCHAR) AS max_value FROM region UNION ALL SELECT 'r_name', count(*), count(*) - count(r_name), min(r_name), max(r_name) FROM region")
def column_statistics(spark, sf_dir):  # S17 O4
    return parquet.column_statistics(table(spark, sf_dir, "region"))


@query("SELECT o_orderkey AS k, o_totalprice * 2 + 1 AS a, (o_totalprice - 10) * (o_totalprice + 10) AS b, CAST(o_orderkey % 7 AS BIGINT) AS m, o_totalprice / 4 AS q FROM orders")
def arithmetic(spark, sf_dir):  # P6 FN14-FN16
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (p * 2 + 1).alias("a"), ((p - 10) * (p + 10)).alias("b"), (F.col("o_orderkey") % 7).alias("m"), (p / 4).alias("q"))


@query("SELECT *, s_acctbal * 2 AS twice FROM supplier")
def select_star_and_expression(spark, sf_dir):  # P3 P4
    return table(spark, sf_dir, "supplier").select("*", (F.col("s_acctbal") * 2).alias("twice"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN CASE WHEN o_orderstatus = 'F' THEN 'mid-done' ELSE 'mid' END ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS open_customer FROM orders ORDER BY band, o_orderkey")
def case_expression(spark, sf_dir):  # P7 K2
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    band = F.when(p > 200000, "high").when(p > 100000, F.when(s == "F", "mid-done").otherwise("mid")).otherwise("low")
    return table(spark, sf_dir, "orders").select("o_orderkey", band.alias("band"), F.when(s == "O", F.col("o_custkey")).alias("open_customer")).orderBy("band", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_totalprice > 150000 THEN 2 ELSE 1 END = CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AND CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority IS NULL THEN 1 ELSE 0 END = 1")
def case_in_comparison(spark, sf_dir):  # P8
    left = F.when(F.col("o_totalprice") > 150000, 2).otherwise(1)
    right = F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    urgent = F.when(F.col("o_orderpriority").like("1%") | F.col("o_orderpriority").isNull(), 1).otherwise(0)
    return table(spark, sf_dir, "orders").filter((left == right) & (urgent == 1)).select("o_orderkey")


@query("SELECT n.n_name, r.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_projection(spark, sf_dir):  # P9
    n, r = table(spark, sf_dir, "nation").alias("n"), table(spark, sf_dir, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.n_name", "r.*")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AND NOT (l_tax > 0.05) AS flag FROM lineitem")
def expression_tree(spark, sf_dir):  # P10 P11 F24
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(*LINE, net.alias("net"), ((F.col("l_quantity") > 25) & ~(F.col("l_tax") > 0.05)).alias("flag"))


_NAMED = "SELECT o_orderstatus, COUNT(*), SUM(o_custkey), sum(o.o_custkey), MAX(o_orderdate) AS latest, count(*), UPPER(o_orderstatus), CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, (SELECT MAX(r_regionkey) FROM region), CAST(length(o_orderstatus) AS BIGINT) * 2 FROM orders o GROUP BY o_orderstatus"


@query(f"SELECT * FROM ({_NAMED}) AS t(o_orderstatus, count, sum_o_custkey, sum_o_custkey_2, latest, count_2, upper, case_expr, subquery, expr)")
def automatic_names(spark, sf_dir):  # P12
    return Engine(spark, data_path=sf_dir).execute(_NAMED)


# --- output ----------------------------------------------------------------------------------------------------------

_REGIONS = "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey"


@query("SELECT 'r_regionkey' || chr(9) || 'r_name' AS line UNION ALL SELECT r_regionkey || chr(9) || r_name FROM region")
def output_as_text(spark, sf_dir):  # S16
    return spark.createDataFrame([(x,) for x in Engine(spark, data_path=sf_dir).execute_to_table(_REGIONS).split("\n")], "line string")


@query("SELECT r_regionkey, r_name FROM region")
def output_as_json(spark, sf_dir):  # S16
    found = json.loads(Engine(spark, data_path=sf_dir).execute_to_json(_REGIONS))
    return spark.createDataFrame([(x["r_regionkey"], x["r_name"]) for x in found], "r_regionkey int, r_name string")


@query("SELECT 'table: region' AS line UNION ALL SELECT 'rows: ' || count(*) FROM region UNION ALL SELECT '  ' || column_name || ': ' || replace(replace(lower(column_type), 'integer', 'int'), 'varchar', 'string') FROM (DESCRIBE SELECT * FROM region)")
def table_description(spark, sf_dir):  # S16
    return spark.createDataFrame([(x,) for x in Engine(spark, data_path=sf_dir).table_info("region").split("\n")], "line string")


# --- filters ---------------------------------------------------------------------------------------------------------


def _filter(name: str, source: str, columns: list[str], where: str, condition) -> None:
    """A filter query: its columns, its SQL condition, and the condition as a Column."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).filter(condition()).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {source} WHERE {where}")(run)


C = F.col
_filter("filter_equal", "orders", ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'F'", lambda: C("o_orderstatus") == "F")  # F1
_filter("filter_not_equal", "orders", ["o_orderkey"], "o_orderstatus <> 'F'", lambda: C("o_orderstatus") != "F")  # F2
_filter("filter_less", "lineitem", LINE, "l_quantity < 5 AND l_discount <= 0.02", lambda: (C("l_quantity") < 5) & (C("l_discount") <= 0.02))  # F3
_filter("filter_greater", "lineitem", LINE, "l_quantity > 45 AND l_tax >= 0.07", lambda: (C("l_quantity") > 45) & (C("l_tax") >= 0.07))  # F4 F23
_filter("filter_between", "lineitem", LINE, "l_discount BETWEEN 0.03 AND 0.05", lambda: C("l_discount").between(0.03, 0.05))  # F5
_filter("filter_not_between", "lineitem", LINE, "l_discount NOT BETWEEN 0.02 AND 0.09", lambda: ~C("l_discount").between(0.02, 0.09))  # F6
_filter("filter_in", "orders", ["o_orderkey"], "o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda: C("o_orderpriority").isin("1-URGENT", "2-HIGH"))  # F7
_filter("filter_not_in", "orders", ["o_orderkey"], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", lambda: ~C("o_orderpriority").isin("1-URGENT", "2-HIGH"))  # F8
_filter("filter_like", "part", ["p_partkey"], "p_type LIKE '%O_%' AND p_brand LIKE 'Brand%'", lambda: C("p_type").like("%O_%") & C("p_brand").like("Brand%"))  # F9
_filter("filter_like_escape", "customer", ["c_custkey"], r"c_name LIKE '%#%' AND c_name NOT LIKE '%\_%' ESCAPE '\'", lambda: C("c_name").like("%#%") & ~C("c_name").like(r"%\_%"))  # F9
_filter("filter_not_like", "part", ["p_partkey"], "p_type NOT LIKE '%E%'", lambda: ~C("p_type").like("%E%"))  # F10
_filter("filter_ilike", "part", ["p_partkey"], "p_type ILIKE '%e%' AND p_name NOT ILIKE '%A%'", lambda: C("p_type").ilike("%e%") & ~C("p_name").ilike("%A%"))  # F10
_filter("filter_and_or", "lineitem", LINE, "(l_quantity < 3 OR l_quantity > 48) AND (l_returnflag = 'R' OR (l_linestatus = 'O' AND l_tax > 0.06))", lambda: rel.every(rel.either(C("l_quantity") < 3, C("l_quantity") > 48), rel.either(C("l_returnflag") == "R", rel.every(C("l_linestatus") == "O", C("l_tax") > 0.06))))  # F12
_filter("filter_not", "orders", ["o_orderkey"], "NOT (o_orderstatus = 'F' OR o_totalprice < 100000)", lambda: ~((C("o_orderstatus") == "F") | (C("o_totalprice") < 100000)))  # F13
_filter("filter_column_to_column", "lineitem", LINE, "l_tax < l_discount AND l_partkey <> l_suppkey", lambda: (C("l_tax") < C("l_discount")) & (C("l_partkey") != C("l_suppkey")))  # F14
_filter("filter_function", "customer", ["c_custkey"], "upper(c_mktsegment) = 'BUILDING' AND length(c_name) > 10", lambda: (F.upper("c_mktsegment") == "BUILDING") & (F.length("c_name") > 10))  # F15
_filter("filter_operator_table", "orders", ["o_orderkey"], "o_totalprice >= 1000 AND o_custkey <= 100", lambda: rel.compare(C("o_totalprice"), ">=", 1000) & rel.compare(C("o_custkey"), "<=", 100))  # F22


@query("SELECT c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
def filter_is_null(spark, sf_dir):  # F11
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").filter(o["o_orderkey"].isNull()).select("c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NOT NULL")
def filter_is_not_null(spark, sf_dir):  # F11
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 300000)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").filter(o["o_orderkey"].isNotNull()).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def in_subquery(spark, sf_dir):  # F16 J10
    o = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 250000)
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def not_in_subquery(spark, sf_dir):  # F16 J11
    o = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 250000)
    return rel.not_in(table(spark, sf_dir, "customer"), "c_custkey", o, "o_custkey").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def exists_subquery(spark, sf_dir):  # F17 J10
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def not_exists_subquery(spark, sf_dir):  # F18 J11
    o = table(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 200000)
    c = table(spark, sf_dir, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")
def exists_uncorrelated(spark, sf_dir):  # F17
    return Engine(spark, data_path=sf_dir).execute("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)")


def _engine(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose SQL text the engine runs as it is."""

    def run(spark, sf_dir):
        engine = Engine(spark, data_path=sf_dir)
        engine.cache.enabled = False  # each run computes its result
        return engine.execute(sql)

    run.__name__ = name
    query(oracle or sql)(run)


_engine("scalar_subquery_compare", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")  # F19 Q2
_engine("correlated_scalar_compare", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")  # F19 Q1 Q3
_engine("correlated_in", "SELECT n_name FROM nation n WHERE n_nationkey IN (SELECT c_nationkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c_acctbal > 9000)")  # F20
_engine("scalar_subquery_in_select", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders, (SELECT max(r_regionkey) FROM region) AS top FROM customer c")  # F21 Q3
_engine("derived_table", "SELECT x.seg, x.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) x WHERE x.n > 1")  # Q4

# --- joins -----------------------------------------------------------------------------------------------------------


def _join(name: str, how: str, sql_join: str, hint: str | None = None) -> None:
    """customer against orders, by join type and strategy."""

    def run(spark, sf_dir):
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        return rel.theta_join(c, o, c["c_custkey"] == o["o_custkey"], how, hint)

    run.__name__ = name
    query(f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer {sql_join} JOIN orders ON c_custkey = o_custkey")(run)


_join("join_inner", "inner", "INNER")  # J1
_join("join_left", "left", "LEFT")  # J2
_join("join_right", "right", "RIGHT")  # J3
_join("join_full", "full", "FULL")  # J4
_join("join_hash", "left", "LEFT", "shuffle_hash")  # J9 J12
_join("join_merge", "inner", "INNER", "merge")  # J13


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, sf_dir):  # J5
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey")
def join_theta(spark, sf_dir):  # J1
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return rel.theta_join(n, r, n["n_regionkey"] > r["r_regionkey"]).select("n_name", "r_name")


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000 AND c_mktsegment = 'BUILDING'")
def join_then_filter(spark, sf_dir):  # J6
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).filter((F.col("o_totalprice") > 250000) & (F.col("c_mktsegment") == "BUILDING")).select("c_name", "o_orderkey")


@query(f"SELECT r_name, n_name, count(*) AS n_orders, {M.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name ORDER BY r_name, n_name")
def join_many_then_aggregate(spark, sf_dir):  # J7 J8 J14
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(partition.broadcast_if_small(n), c["c_nationkey"] == n["n_nationkey"]).join(partition.broadcast_if_small(r), n["n_regionkey"] == r["r_regionkey"])
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), money("o_totalprice").alias("total")).orderBy("r_name", "n_name")


@query("SELECT l.l_orderkey, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate GROUP BY l.l_orderkey")
def join_equi_and_theta(spark, sf_dir):  # J8
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, (li["l_orderkey"] == o["o_orderkey"]) & (li["l_shipdate"] > o["o_orderdate"])).groupBy("l_orderkey").agg(F.count("*").alias("n"))


# --- aggregation -----------------------------------------------------------------------------------------------------


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {M.format('l_quantity')} AS sum_qty, {M.format('l_extendedprice')} AS sum_price, {M.format('l_quantity')} / count(*) AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
def agg_pricing_summary(spark, sf_dir):  # A1 A3 A4 A7
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), (money("l_quantity") / F.count("*")).alias("avg_qty")).orderBy("l_returnflag", "l_linestatus")


@query(f"SELECT count(*) AS n, count(o_orderpriority) AS n_priority, {M.format('o_totalprice')} AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, min(o_orderpriority) AS first_priority, max(o_orderdate) AS last_date FROM orders")
def agg_global(spark, sf_dir):  # A1 A2 A3 A5 A6 A11
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("n_priority"), money("o_totalprice").alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.min("o_orderpriority").alias("first_priority"), F.max("o_orderdate").alias("last_date"))


@query(f"SELECT count(*) AS n, {M.format('o_totalprice')} AS total, max(o_totalprice) AS most FROM orders WHERE o_totalprice < 0")
def agg_empty_input(spark, sf_dir):  # A3 A6
    return table(spark, sf_dir, "orders").filter(F.col("o_totalprice") < 0).agg(F.count("*").alias("n"), money("o_totalprice").alias("total"), F.max("o_totalprice").alias("most"))


@query("SELECT year(o_orderdate)::BIGINT AS y, CAST(sum(CAST(o_totalprice * 2 AS DECIMAL(18,2))) AS DOUBLE) AS twice, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_expressions(spark, sf_dir):  # A8 A9 A14
    twice = F.sum((F.col("o_totalprice") * 2).cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(twice.alias("twice"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_without_aggregate(spark, sf_dir):  # A9
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having(spark, sf_dir):  # A7
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("SELECT event_type, count(*) AS n, count(value) AS n_value, min(value) AS least, max(value) AS most, arg_min(event_id, event_id) AS first_event, arg_max(event_id, event_id) AS last_event FROM events GROUP BY event_type")
def agg_hash(spark, sf_dir):  # A10 A16
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.min("value").alias("least"), F.max("value").alias("most"), F.min_by("event_id", "event_id").alias("first_event"), F.max_by("event_id", "event_id").alias("last_event"))


@query(f"SELECT o_orderpriority, count(*) AS n, {M.format('o_totalprice')} AS total, {M.format('o_totalprice')} / count(*) AS mean, min(o_orderdate) AS first_date FROM orders GROUP BY o_orderpriority")
def agg_partial_final(spark, sf_dir):  # A12 A13 A15
    spread = partition.round_robin(table(spark, sf_dir, "orders"), 7)
    return spread.groupBy("o_orderpriority").agg(F.count("*").alias("n"), money("o_totalprice").alias("total"), (money("o_totalprice") / F.count("*")).alias("mean"), F.min("o_orderdate").alias("first_date"))


# --- windows ---------------------------------------------------------------------------------------------------------

OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, CAST(row_number() {OVER} AS BIGINT) AS rn, lag(o_totalprice) {OVER} AS before, lag(o_totalprice, 2, 0) {OVER} AS before2, lead(o_orderkey, 1) {OVER} AS after, lead(o_totalprice, 3, -1) {OVER} AS after3 FROM orders")
def window_row_number_lag_lead(spark, sf_dir):  # W1 W4 W5 W8
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = "o_totalprice"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.lag(p).over(w).alias("before"), F.lag(p, 2, 0.0).over(w).alias("before2"), F.lead("o_orderkey", 1).over(w).alias("after"), F.lead(p, 3, -1.0).over(w).alias("after3"))


@query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS d FROM part")
def window_rank(spark, sf_dir):  # W2 W3 W6 W7
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc())
    return table(spark, sf_dir, "part").select("p_partkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"))


@query("SELECT n_nationkey, CAST(rank() OVER (PARTITION BY n_regionkey) AS BIGINT) AS r FROM nation")
def window_rank_without_order(spark, sf_dir):  # W2
    return table(spark, sf_dir, "nation").select("n_nationkey", F.rank().over(Window.partitionBy("n_regionkey").orderBy(F.lit(1))).cast("bigint").alias("r"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3 FROM orders")
def window_frame(spark, sf_dir):  # W10
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("last3"))


# --- sort, limit, top-k ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey DESC, o_totalprice ASC, o_orderkey")
def sort_many_keys(spark, sf_dir):  # K1 K8
    return rel.sort(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ("o_custkey", "desc", "last"), "o_totalprice", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 10 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def top_k(spark, sf_dir):  # K4 K5
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 10).select(*LINE, "l_extendedprice")
    return rel.top_k(line, 20, F.col("l_extendedprice").desc(), *map(F.col, LINE))


@query("SELECT n_nationkey, n_name FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) ORDER BY n_name DESC, n_nationkey LIMIT 7")
def top_k_multi_file(spark, sf_dir):  # K6 K9
    return rel.top_k(parquet.scan_files(spark, [f"{sf_dir}/nation.parquet"] * 2).select("n_nationkey", "n_name"), 7, F.col("n_name").desc(), F.col("n_nationkey"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_k_per_group(spark, sf_dir):  # W1 K4
    return rel.top_k_per(table(spark, sf_dir, "orders"), 2, ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(spark, sf_dir):  # K3
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(25).limit(10).select("o_orderkey")


@query("SELECT c_custkey, low FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS low FROM customer) ORDER BY low ASC NULLS FIRST, c_custkey")
def sort_null_order(spark, sf_dir):  # K1
    low = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("low")
    return rel.sort(table(spark, sf_dir, "customer").select("c_custkey", low), ("low", "asc", "first"), "c_custkey")


# --- set operations and CTEs -----------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all(spark, sf_dir):  # U1
    return rel.union_chain([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey")], distinct=False)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):  # U2
    return rel.union_chain([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey")], distinct=True)


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region ORDER BY name LIMIT 12")
def union_sort_limit(spark, sf_dir):  # K7
    return rel.top_k(rel.union_chain([table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select("r_name")], True), 12, F.col("name"))


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf_dir):  # U3
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(spark, sf_dir):  # U3
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


_engine("cte_chain", "WITH big AS (SELECT o_custkey AS cust, o_totalprice AS price FROM orders WHERE o_totalprice > 150000), per AS (SELECT cust, count(*) AS n, max(price) AS most FROM big GROUP BY cust) SELECT cust, n, most FROM per WHERE n >= 3 ORDER BY n DESC, cust LIMIT 40")  # C1
_engine("cte_column_list", "WITH x(a, b) AS (SELECT n_name, n_regionkey FROM nation) SELECT upper(a) AS ua, b FROM x WHERE b IN (1, 3)")  # C1
_engine("cte_union", "WITH a AS (SELECT n_name AS name FROM nation WHERE n_regionkey = 0), b AS (SELECT r_name AS name FROM region) SELECT name FROM a UNION SELECT name FROM b")  # C2
_engine("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT CAST(sum(n) AS BIGINT) AS total FROM t")  # C3
_engine("select_distinct", "SELECT DISTINCT o_orderstatus FROM orders")  # U2
_engine("count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")  # A14


@query("SELECT true AS pushed, 'o_orderkey:bigint,o_custkey:bigint' AS columns, count(*) AS actual_rows FROM orders WHERE o_custkey = 7")
def explain(spark, sf_dir):  # EX1 O6 O7
    engine = Engine(spark, data_path=sf_dir)
    plan = engine.execute("EXPLAIN ANALYZE SELECT o_orderkey FROM orders WHERE o_custkey = 7")
    pushed = F.col("plan").contains("PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]")
    return plan.select(pushed.alias("pushed"), F.regexp_extract("plan", r"ReadSchema: struct<([^>]*)>", 1).alias("columns"), F.regexp_extract("plan", r"actual_rows: (\d+)", 1).cast("bigint").alias("actual_rows"))


@query("SELECT count(*) AS actual_rows FROM orders WHERE o_totalprice > 100000")
def explain_json(spark, sf_dir):  # EX1
    plan = Engine(spark, data_path=sf_dir).execute("EXPLAIN (ANALYZE, FORMAT JSON) SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
    return plan.select(F.get_json_object("plan", "$.actual_rows").cast("bigint").alias("actual_rows"))


# --- functions -------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, concat(c_name, NULL, '-', c_mktsegment) AS joined, substring(c_name, 1, 4) AS first4, substring(c_name, 6) AS rest, length(c_name) AS n, upper(c_name) AS u, lower(c_mktsegment) AS l,
  trim(concat('  ', c_mktsegment, ' ')) AS t, ltrim(concat('  ', c_mktsegment)) AS lt, rtrim(concat(c_mktsegment, '  ')) AS rt FROM customer""")
def string_functions(spark, sf_dir):  # FN1-FN8 VF1-VF4
    s = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", fn.concat("c_name", F.lit(None), F.lit("-"), s).alias("joined"), fn.substring("c_name", -3, 4).alias("first4"), fn.substring("c_name", 6).alias("rest"), fn.length("c_name").alias("n"), fn.upper("c_name").alias("u"), fn.lower(s).alias("l"), fn.trim(fn.concat(F.lit("  "), s, F.lit(" "))).alias("t"), fn.ltrim(fn.concat(F.lit("  "), s)).alias("lt"), fn.rtrim(fn.concat(s, F.lit("  "))).alias("rt"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(date_part('{p}', o_orderdate) AS BIGINT) AS p_{p}" for p in ("year", "month", "day", "hour", "minute", "second", "dow", "doy", "quarter")) + " FROM orders")
def date_parts(spark, sf_dir):  # FN11 FN12
    return table(spark, sf_dir, "orders").select("o_orderkey", *[fn.date_part(p, "o_orderdate").alias(f"p_{p}") for p in ("year", "month", "day", "hour", "minute", "second", "dow", "doy", "quarter")])


@query("SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS TIMESTAMP) AS t_{u}" for u in fn.TRUNC_UNITS) + " FROM orders")
def date_truncs(spark, sf_dir):  # FN13
    return table(spark, sf_dir, "orders").select("o_orderkey", *[fn.date_trunc(u, "o_orderdate").alias(f"t_{u}") for u in fn.TRUNC_UNITS])


@query("SELECT strftime(now()::TIMESTAMP, '%Y-%m-%d') AS today, strftime(now()::TIMESTAMP, '%Y-%m-%d') AS day_of_now, 19::BIGINT AS n")
def now_and_current_date(spark, sf_dir):  # FN9 FN10
    return spark.range(1).select(fn.current_date_text().alias("today"), fn.substring(fn.now_text(), 1, 10).alias("day_of_now"), fn.length(fn.now_text()).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * l_tax AS m, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS d, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % CAST(l_linenumber % 2 AS BIGINT) END AS r FROM lineitem")
def arithmetic_functions(spark, sf_dir):  # FN14-FN18 VF8
    return table(spark, sf_dir, "lineitem").select(*LINE, fn.add("l_quantity", "l_tax").alias("a"), fn.subtract("l_quantity", "l_tax").alias("s"), fn.multiply("l_quantity", "l_tax").alias("m"), fn.divide("l_quantity", "l_discount").alias("d"), fn.modulo("l_quantity", F.col("l_linenumber") % 2).alias("r"))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, sqrt(abs(s_acctbal)) AS q, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_acctbal) AS r, substring(s_name, 2, 3) AS s FROM supplier")
def math_functions(spark, sf_dir):  # VF5-VF7
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.abs(b).alias("a"), F.sqrt(F.abs(b)).alias("q"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(b).alias("r"), F.substring("s_name", 2, 3).alias("s"))


_engine(
    "dialect_functions",
    "SELECT o_orderkey, CONCAT(o_orderstatus, NULL, '/', o_orderpriority) AS c, DATE_PART('dow', o_orderdate) AS dow, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, SUBSTRING(o_orderpriority, 0, 3) AS s, o_totalprice / 0 AS z FROM orders",
    "SELECT o_orderkey, concat(o_orderstatus, '/', o_orderpriority) AS c, CAST(date_part('dow', o_orderdate) AS INT) AS dow, date_part('year', o_orderdate) AS y, substring(o_orderpriority, 1, 3) AS s, CAST(NULL AS DOUBLE) AS z FROM orders",
)  # FN1 FN2 FN11 FN12 FN17

# --- row index -------------------------------------------------------------------------------------------------------

NUMBERED = "(SELECT *, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS row_num FROM (SELECT event_id, user_id, event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events))"


def index(spark, sf_dir) -> RowIndex:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    return RowIndex(number_rows(events, "event_id"))


def _rows(name: str, where: str, condition) -> None:
    def run(spark, sf_dir):
        x = index(spark, sf_dir)
        return x.rows(condition(x))

    run.__name__ = name
    query(f"SELECT row_num FROM {NUMBERED} WHERE {where}")(run)


_rows("rows_equal", "user_id = 7 OR event_type = 'click'", lambda x: x.any_of(x.eq("user_id", 7), None, x.eq("event_type", "click")))  # X1 X6
_rows("rows_between", "user_id BETWEEN 10 AND 30 AND event_type BETWEEN 'a' AND 'p'", lambda x: x.all_of(x.between("user_id", 10, 30), x.between("event_type", "a", "p")))  # X2 X6
_rows("rows_compare", "(user_id > 90 OR user_id >= 95) AND (value < 50 OR value <= 60)", lambda x: x.all_of(x.any_of(x.greater("user_id", 90), x.greater("user_id", 95, True)), x.any_of(x.less("value", 50), x.less("value", 60, True))))  # X3
_rows("rows_nulls_first", "value < 20 OR value IS NULL", lambda x: x.less("value", 20, nulls=NULLS_FIRST))  # X4
_rows("rows_nulls_last", "value > 80 OR value IS NULL", lambda x: x.any_of(x.greater("value", 80, nulls=NULLS_LAST), x.between("value", 90, None, NULLS_LAST)))  # X4
_rows("rows_null", "value IS NULL", lambda x: x.is_null("value"))  # X5
_rows("rows_not_null", "value IS NOT NULL", lambda x: x.not_null("value"))  # X5
_rows("rows_not", "value IS NOT NULL AND NOT (value > 30)", lambda x: x.none_of("value", x.greater("value", 30)))  # X7


@query(f"SELECT count(*) AS n FROM {NUMBERED} WHERE user_id < 20 OR event_type = 'view'")
def rows_bitmap_union(spark, sf_dir):  # X8
    x = index(spark, sf_dir)
    a, b = x.bitmap(x.rows(x.less("user_id", 20))), x.bitmap(x.rows(x.eq("event_type", "view")))
    return x.bitmap_cardinality(x.union_bitmaps(a, b))


@query(f"SELECT row_num FROM {NUMBERED} WHERE user_id < 20 AND value > 10")
def rows_intersect(spark, sf_dir):  # X6 X8
    x = index(spark, sf_dir)
    return x.intersect(x.rows(x.less("user_id", 20)), x.rows(x.greater("value", 10)))


@query(f"SELECT event_id, user_id FROM {NUMBERED} WHERE row_num = 123")
def rows_lookup(spark, sf_dir):  # X9
    return index(spark, sf_dir).lookup(123, "event_id", "user_id")


@query(f"SELECT user_id AS key, count(*) AS n, min(row_num) AS first_row FROM {NUMBERED} WHERE user_id BETWEEN 5 AND 25 GROUP BY user_id")
def rows_iterate_range(spark, sf_dir):  # X10 X11
    x = index(spark, sf_dir)
    return x.key_counts(x.keys("user_id", descending=True, low=5, high=25))


@query(f"SELECT user_id AS key, row_num FROM {NUMBERED} WHERE user_id BETWEEN 5 AND 25")
def rows_of_keys(spark, sf_dir):  # X10
    x = index(spark, sf_dir)
    return x.rows_of(x.keys("user_id", low=5, high=25))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS row_num FROM lineitem")
def rows_numbered_lineitem(spark, sf_dir):  # X9 S20
    return number_rows(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT doc_id, text, lang, source, n_chars, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_num FROM documents")
def rows_numbered_documents(spark, sf_dir):  # X9
    return number_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")


def _tree(spark, sf_dir) -> RowIndex:
    pairs = index(spark, sf_dir).df.select(F.col("user_id").alias("key"), "row_num")
    return RowIndex.bulk_load(pairs, fresh_path(spark, "key-rows"))


@query(f"SELECT row_num FROM {NUMBERED} WHERE user_id = 12")
def tree_find(spark, sf_dir):  # X15
    return _tree(spark, sf_dir).find("key", 12)


@query(f"SELECT user_id AS key, row_num FROM {NUMBERED} WHERE user_id BETWEEN 10 AND 40 ORDER BY 1, 2")
def tree_range_search(spark, sf_dir):  # X15
    return _tree(spark, sf_dir).range_search("key", 10, 40)


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_num, CAST(n_nationkey * 10 AS BIGINT) AS id, CASE WHEN n_regionkey <> 1 THEN n_name END AS name FROM nation WHERE n_regionkey <> 3")
def row_store(spark, sf_dir):  # S20 S21
    path, nation = fresh_path(spark, "row-store"), table(spark, sf_dir, "nation").withColumn("row_num", F.col("n_nationkey").cast("bigint"))
    store = RowStore.create(spark, path, "zstd")
    store.add_column("id", "int64", nullable=False)
    store.add_column("name", "string")
    store.load("id", nation.select("row_num", (F.col("n_nationkey") * 10).alias("id")))
    store.load("name", nation.select("row_num", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name")))
    store.close()
    RowStore.open(spark, path).delete(nation.filter("n_regionkey = 3").select("row_num"))
    return RowStore.open(spark, path, read_only=True).index().live()


@query(f"SELECT user_id AS key, count(*) AS n FROM {NUMBERED} WHERE user_id = (SELECT min(user_id) FROM events WHERE user_id >= 50) GROUP BY user_id")
def rows_seek(spark, sf_dir):  # X10
    x = index(spark, sf_dir)
    return x.key_counts(x.seek("user_id", 50)).select("key", "n")


@query(f"SELECT event_id FROM {NUMBERED} WHERE event_type = 'click' AND user_id < 5")
def rows_fetch(spark, sf_dir):  # X12
    x = index(spark, sf_dir)
    return x.fetch(x.rows(x.all_of(x.eq("event_type", "click"), x.less("user_id", 5)))).select("event_id")


@query(f"SELECT row_num FROM {NUMBERED} WHERE user_id < 10 AND (event_type <> 'click' OR user_id = 3)")
def rows_deleted(spark, sf_dir):  # X13
    x = index(spark, sf_dir)
    x = x.delete(x.rows(x.eq("event_type", "click"))).undelete(x.rows(x.eq("user_id", 3)))
    return x.rows(x.less("user_id", 10), live=True)


@query(f"SELECT count(*) AS n_rows, count(DISTINCT value) AS n_distinct, count(*) - count(value) AS n_nulls, min(value) AS min_value, max(value) AS max_value FROM {NUMBERED}")
def rows_stats(spark, sf_dir):  # X14
    return index(spark, sf_dir).stats("value")


# --- merge -----------------------------------------------------------------------------------------------------------

SPLIT = "(SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 12 THEN 0 ELSE 1 END AS file_idx, CAST(CASE WHEN n_nationkey < 12 THEN n_nationkey ELSE n_nationkey - 12 END AS BIGINT) AS row_num, CASE WHEN n_nationkey >= 12 THEN n_regionkey END AS n_regionkey FROM nation)"


def files(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter(F.col("n_nationkey").isNotNull())
    a = number_rows(nation.filter("n_nationkey < 12").select("n_nationkey", "n_name"), "n_nationkey")
    b = number_rows(nation.filter("n_nationkey >= 12").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    return [a, b]


@query(f"SELECT file_idx, row_num, n_nationkey, n_name, n_regionkey FROM {SPLIT} WHERE row_num NOT IN (3, 5)")
def merge_files(spark, sf_dir):  # M1
    gone = spark.createDataFrame([(3,), (5,)], "row_num bigint")
    return merge.merge_rows(files(spark, sf_dir), [gone])


@query("SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS row_num, v AS n_regionkey FROM (SELECT DISTINCT n_regionkey AS v FROM nation WHERE n_nationkey >= 12)")
def merge_column_distinct(spark, sf_dir):  # M2
    return merge.merge_column(files(spark, sf_dir), "n_regionkey")


@query(f"SELECT n_name AS key, count(DISTINCT row_num) AS n, min(row_num) AS first_row FROM {SPLIT} GROUP BY n_name")
def merge_key_index(spark, sf_dir):  # M3
    return RowIndex.key_counts(merge.merge_keys(files(spark, sf_dir), "n_name"))


@query(f"SELECT row_num, file_idx, n_name FROM {SPLIT} ORDER BY row_num, file_idx")
def merge_row_order(spark, sf_dir):  # M4
    return merge.merge_by_row(files(spark, sf_dir), "n_name")


@query("SELECT n_regionkey AS r_regionkey, coalesce(max(n_nationkey) FILTER (n_nationkey >= 12), max(n_nationkey)) AS n_nationkey FROM nation GROUP BY n_regionkey")
def merge_keep_latest(spark, sf_dir):  # M5
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    parts = [number_rows(nation.filter(c), "n_nationkey") for c in ("n_nationkey < 12", "n_nationkey >= 12")]
    return merge.keep_latest(parts, "r_regionkey").select("r_regionkey", "n_nationkey")


# --- statistics, partitioning ----------------------------------------------------------------------------------------


@query("SELECT bucket, lo + (bucket - 1) * ((hi - lo) / 10) AS low, lo + bucket * ((hi - lo) / 10) AS high, count(*) AS n FROM (SELECT CAST(least(floor((p_size - lo) / ((hi - lo) / 10)) + 1, 10) AS BIGINT) AS bucket, lo, hi FROM (SELECT CAST(p_size AS DOUBLE) AS p_size, CAST(min(p_size) OVER () AS DOUBLE) AS lo, CAST(max(p_size) OVER () AS DOUBLE) AS hi FROM part)) GROUP BY bucket, lo, hi")
def stats_histogram(spark, sf_dir):  # O3
    return stats.histogram(table(spark, sf_dir, "part"), "p_size")


@query("SELECT 'c_mktsegment' AS column_name, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_distinct, count(*) - count(c_mktsegment) AS n_nulls, min(c_mktsegment) AS min_value, max(c_mktsegment) AS max_value, avg(length(c_mktsegment)) AS avg_length FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey), count(*) - count(c_nationkey), CAST(min(c_nationkey) AS VARCHAR), CAST(max(c_nationkey) AS VARCHAR), NULL FROM customer")
def stats_profile(spark, sf_dir):  # O3
    return stats.column_profile(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"), exact=True)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def cached_query(spark, sf_dir):  # O1 O2
    engine = Engine(spark, data_path=sf_dir)
    engine.execute("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    out = engine.execute("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    assert engine.cache.stats()["hits"] == 1
    return out


def _dealt(name: str, strategy: str) -> None:
    """A grouped count over differently partitioned input."""

    def run(spark, sf_dir):
        return partition.apply(table(spark, sf_dir, "orders"), strategy, 5).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("most"))

    run.__name__ = name
    query("SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS most FROM orders GROUP BY o_orderstatus")(run)


_dealt("partition_hash", partition.choose(join_keys=["o_custkey"]))  # D1 D5
_dealt("partition_range", partition.choose(range_column="o_orderdate"))  # D2
_dealt("partition_round_robin", partition.choose())  # D3
_dealt("partition_broadcast", partition.choose(size=1000))  # D4


@query(f"SELECT c_mktsegment, count(*) AS n, {M.format('o_totalprice')} AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3")
def distributed_complex(spark, sf_dir):  # D6 D7 D8
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    mean = o.agg(F.avg("o_totalprice").alias("mean"))
    big = o.select("o_custkey", "o_totalprice").join(F.broadcast(mean), F.col("o_totalprice") > F.col("mean"))  # one row
    big = partition.by_hash(big, partition.count_for(partition.estimated_bytes(o), 4), "o_custkey")
    return big.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), money("o_totalprice").alias("total")).orderBy(F.col("n").desc(), "c_mktsegment").limit(3)


def queries():
    return dict(_queries)


def oracle_sql():
    return dict(_oracles)
