"""Scalar shims on NULLs, zeros, white space and the layouts of times."""

import datetime

import pytest

from strataq.functions import scalar as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    from pyspark.sql import functions as F

    lit = F.lit
    assert one(spark, fn.concat(lit("a"), lit(None), lit(3))) == "a3"
    assert one(spark, fn.substring(lit("hello"), -2, 3)) == "hel" and one(spark, fn.substring(lit("hello"), 9)) == ""
    assert one(spark, fn.trim(lit("\t a \n"))) == "a" and one(spark, fn.ltrim(lit("  a "))) == "a " and one(spark, fn.rtrim(lit(" a  "))) == " a"
    assert one(spark, fn.length(lit("é"))) == 1 and one(spark, fn.octets(lit("é"))) == 2
    assert one(spark, fn.divide(lit(1), lit(0))) is None and one(spark, fn.modulo(lit(7.9), lit(4))) == 3 and one(spark, fn.modulo(lit(7), lit(0))) is None
    assert one(spark, fn.add(lit("1.5"), lit(2))) == 3.5 and one(spark, fn.multiply(lit(None), lit(2))) is None


@pytest.mark.parametrize("text", ["2020-01-15 10:20:30", "2020-01-15T10:20:30", "2020-01-15T10:20:30Z"])
def test_time_layouts(spark, text):
    from pyspark.sql import functions as F

    assert one(spark, fn.date_part("minute", F.lit(text), text=True)) == 20
    assert one(spark, fn.date_trunc("hour", F.lit(text), text=True)) == datetime.datetime(2020, 1, 15, 10)


def test_date_parts(spark):
    from pyspark.sql import functions as F

    day = F.lit("2020-01-19")  # a Sunday
    assert [one(spark, fn.date_part(p, day, text=True)) for p in ("dow", "doy", "quarter", "second")] == [0, 19, 1, 0]
    assert one(spark, fn.date_part("year", F.lit("no date"), text=True)) is None
    with pytest.raises(ValueError):
        fn.date_part("century", day)
