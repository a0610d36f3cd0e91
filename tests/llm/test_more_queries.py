"""The registered set as a whole."""

import inspect

import __spark_entry__
from strataq.llm import pii, quality, queries


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries())


def test_native_operators_hold_no_python_functions():
    for module in (pii, quality):
        text = inspect.getsource(module)
        assert not any(word in text for word in ("mapInArrow", "applyIn", "pandas", "udf", ".rdd"))
