"""Numbered rows: predicates, NULL policies, iteration, tombstones, merge."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.operators import merge
from strataq.operators.rowindex import NULLS_FIRST, NULLS_LAST, RowIndex, number_rows
from strataq.sources.parquet import SchemaMismatch

ROWS = [(k, [25, 30, 35, None, 25, 40, 30, None, 50, 20][k], f"name{k % 4}") for k in range(10)]


@pytest.fixture(scope="module")
def index(spark):
    return RowIndex(spark.createDataFrame(ROWS, "row_num bigint, age int, name string"))


def nums(df):
    return sorted(r.row_num for r in df.collect())


def test_predicates(index):
    age = {k: a for k, a, _ in ROWS}
    want = lambda f: sorted(k for k, a in age.items() if f(a))
    assert nums(index.rows(index.eq("age", 25))) == want(lambda a: a == 25)
    assert nums(index.rows(index.between("age", 25, 35))) == want(lambda a: a is not None and 25 <= a <= 35)
    assert nums(index.rows(index.less("age", 30))) == want(lambda a: a is not None and a < 30)
    assert nums(index.rows(index.less("age", 30, nulls=NULLS_FIRST))) == want(lambda a: a is None or a < 30)
    assert nums(index.rows(index.less("age", 30, nulls=NULLS_LAST))) == want(lambda a: a is not None and a < 30)
    assert nums(index.rows(index.greater("age", 30, True, NULLS_LAST))) == want(lambda a: a is None or a >= 30)
    assert nums(index.rows(index.is_null("age"))) == [3, 7]
    assert nums(index.rows(index.none_of("age", index.eq("age", 25)))) == want(lambda a: a not in (None, 25))
    assert index.cardinality(index.all_of(index.greater("age", 20), None, index.eq("name", "name0"))) == 3


def test_iteration(index):
    keys = index.keys("age")
    assert [r.key for r in keys.collect()] == [20, 25, 30, 35, 40, 50]
    assert {(r.key, r.row_num) for r in index.rows_of(keys).collect()} == {(a, k) for k, a, _ in ROWS if a is not None}
    assert {r.key: (r.n, r.first_row) for r in index.key_counts(keys).collect()}[25] == (2, 0)
    assert [r.key for r in index.keys("age", True, 25, 40).collect()] == [40, 35, 30, 25]
    assert index.seek("age", 36).first().key == 40 and index.seek("age", 36, False).first().key == 35
    assert index.seek("age", 99).count() == 0


def test_bitmaps_name_their_rows(spark):
    rows = [0, 1, 2, 8, 32_767, 32_768, 32_769, 65_536, 65_537, 10**10]
    x = RowIndex(spark.createDataFrame([(r, "a") for r in rows] + [(5, "b")], "row_num bigint, k string"))
    assert sorted((r.key, r.row_num) for r in x.rows_of(x.keys("k")).collect()) == [*(("a", r) for r in rows), ("b", 5)]


def test_key_tree(spark, tmp_path):
    pairs = spark.createDataFrame([(k % 7, k) for k in range(50)], "key int, row_num bigint")
    tree = RowIndex.bulk_load(pairs, f"{tmp_path}/tree")
    assert nums(tree.find("key", 3)) == [k for k in range(50) if k % 7 == 3]
    assert [(r.key, r.row_num) for r in tree.range_search("key", 2, 3).collect()] == [(x, k) for x in (2, 3) for k in range(50) if k % 7 == x]
    assert "EqualTo(key,3)" in tree.find("key", 3)._jdf.queryExecution().executedPlan().toString()


def test_tombstones(index):
    gone = index.delete(index.rows(index.eq("age", 25)))
    assert nums(gone.rows(index.not_null("age"), live=True)) == [1, 2, 5, 6, 8, 9]
    assert nums(gone.rows(index.eq("age", 25))) == [0, 4]
    back = gone.undelete(index.rows(index.eq("name", "name0")))
    assert nums(back.deleted) == [] and back.live().count() == 10


def test_bitmaps(spark, index):
    a, b = index.rows(index.less("age", 30)), index.rows(index.eq("name", "name0"))
    assert index.bitmap_cardinality(index.union_bitmaps(index.bitmap(a), index.bitmap(b))).first().n == len(set(nums(a)) | set(nums(b)))
    assert nums(index.intersect(a, b)) == sorted(set(nums(a)) & set(nums(b)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_numbering_follows_the_order(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v int")
    got = {r.id: r.row_num for r in number_rows(df, "v", "id").collect()}
    assert got == {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))}


@pytest.mark.parametrize("partitions", ["1", "4", "8"])
def test_numbering_of_wide_rows(spark, partitions):
    """Rows of a kilobyte, a third of them under one key, on different numbers of partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        wide = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "repeat(CAST(id AS STRING), 250) AS pad")
        numbered = number_rows(wide, "k")
        for _ in range(2):  # every read gives the same numbers
            got = sorted((r.row_num, r.k, r.id) for r in numbered.select("row_num", "k", "id").collect())
            assert [n for n, *_ in got] == list(range(6000)) and [k for _, k, _ in got] == sorted(k for _, k, _ in got)
        assert numbered.filter("row_num >= 100 AND row_num < 110").count() == 10
        assert len({i for *_, i in got}) == 6000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbering_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], "v int"), "v").collect() == []


def test_merge(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "row_num bigint, k string, v int")
    b = spark.createDataFrame([(0, "y", 5, None), (1, "z", 6, "o")], "row_num bigint, k string, v int, note string")
    assert merge.merge_rows([a, b]).count() == 4
    assert [(r.file_idx, r.row_num) for r in merge.merge_rows([a, b], [spark.createDataFrame([(0,)], "row_num bigint")]).orderBy("file_idx").collect()] == [(0, 1), (1, 1)]
    assert sorted((r.row_num, r.k) for r in merge.merge_column([a, b], "k").collect()) == [(0, "x"), (1, "y"), (2, "z")]
    assert sorted(map(tuple, RowIndex.rows_of(merge.merge_keys([a, b], "k")).collect())) == [("x", 0), ("y", 0), ("y", 1), ("z", 1)]
    assert {(r.k, r.v) for r in merge.keep_latest([a, b], "k").collect()} == {("x", 1), ("y", 5), ("z", 6)}
    with pytest.raises(SchemaMismatch):
        merge.merge_rows([a, spark.createDataFrame([(0, 7)], "row_num bigint, k int")])
