"""Numbered tables on disk, the shell's commands, the tracer."""

import logging

import pytest

from strataq.cli import answer
from strataq.plans.engine import Engine
from strataq.sources.catalog import Catalog
from strataq.sources.rowstore import RowStore
from strataq.trace import Tracer


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy", "zstd"])
def test_row_store(spark, tmp_path, compression):
    store = RowStore.create(spark, str(tmp_path / "t"), compression)
    store.add_column("id", "int64", nullable=False)
    store.add_column("big", "uint64")
    store.add_column("name", "string")
    store.load("id", [(k, k * 10) for k in range(6)])
    store.load("big", spark.createDataFrame([(k, str(2**64 - 1 - k)) for k in range(5)], "row_num long, big string"))
    store.load("name", [(k, None if k == 2 else f"n{k}") for k in range(6)])
    with pytest.raises(ValueError):
        store.load("id", [(0, None)])
    with pytest.raises(ValueError):
        store.add_column("id", "int64")
    index = store.close()
    assert index.df.count() == 6 and int(index.lookup(0, "big").first().big) == 2**64 - 1
    again = RowStore.open(spark, str(tmp_path / "t"))
    live = again.delete(index.rows(index.eq("id", 30))).live()
    assert sorted(r.id for r in live.collect()) == [0, 10, 20, 40, 50]
    with pytest.raises(PermissionError):
        RowStore.open(spark, str(tmp_path / "t"), read_only=True).delete(index.rows(index.eq("id", 0)))
    assert [r.row_num for r in RowStore.open(spark, str(tmp_path / "t")).index().deleted.collect()] == [3]


def test_shell(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    engine = Engine(spark, data_path=str(tmp_path), catalog=Catalog(spark))
    engine.catalog.register("x", f"{tmp_path}/t.parquet")
    assert answer(engine, "SELECT COUNT(*) AS n FROM t;") == "n\n3"
    assert answer(engine, "\\dt") == "default.default.x" and answer(engine, "\\dn") == "default" and answer(engine, "\\dc") == "default"
    assert "rows: 3" in answer(engine, "\\d x") and answer(engine, "\\l") == "t.parquet"
    assert answer(engine, "\\json SELECT 1 AS a") == '[{"a": 1}]' and "hits" in answer(engine, "\\stats") and answer(engine, "\\q") is None


def test_tracer(caplog):
    tracer = Tracer("QUERY=DEBUG,CACHE=ERROR")
    with caplog.at_level(logging.DEBUG):
        tracer.log("QUERY", "DEBUG", "seen", sql="x")
        tracer.log("CACHE", "INFO", "unseen")
    assert "seen" in caplog.text and "unseen" not in caplog.text
