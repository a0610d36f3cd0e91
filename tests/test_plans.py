"""Plans are what they should be: pushed down, pruned, without needless exchanges."""

from strataq.operators import partition
from strataq.plans import queries as core

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    return core.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_its_columns(spark):
    text = plan(spark, "scan_pruned_columns")
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in text
    assert "Exchange" not in text


def test_filters_reach_the_scan(spark):
    assert "EqualTo(o_orderstatus,F)" in plan(spark, "filter_equal")
    assert "In(o_orderpriority" in plan(spark, "filter_in")


def test_top_k_needs_no_sort_exchange(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_k")


def test_top_k_per_group_limits_before_the_shuffle(spark):
    text = plan(spark, "top_k_per_group")
    assert "WindowGroupLimit" in text and "Partial" in text


def test_exists_is_a_semi_join(spark):
    assert "LeftSemi" in plan(spark, "exists_subquery")
    assert "LeftAnti" in plan(spark, "not_exists_subquery")


def test_aggregates_are_partial_first(spark):
    assert "partial_count" in plan(spark, "agg_pricing_summary")


def test_result_does_not_depend_on_partitioning(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    results = [sorted(map(tuple, partition.round_robin(orders, n).groupBy("o_orderstatus").count().collect())) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]


def test_strategy_choice():
    assert partition.choose(join_keys=["a"], group_keys=["b"]) == "hash:a"
    assert partition.choose(group_keys=["b"]) == "hash:b"
    assert partition.choose(range_column="d") == "range:d"
    assert partition.choose(size=5) == "broadcast"
    assert partition.choose() == "round_robin"
    assert partition.count_for(1 << 30, 4) == 8 and partition.count_for(50 << 30, 4) == 16 and partition.count_for(1, 4) == 1
