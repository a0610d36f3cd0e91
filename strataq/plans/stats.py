"""Table statistics: counts, distinct values, bounds, mean text length, equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 10


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row for each atomic column, all from one aggregation; distinct values by sketch, or exactly (which shuffles them)."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    atomic = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    parts = []
    for f in atomic:
        c = F.col(f.name)
        text = F.avg(F.length(c)) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(f.name).alias("column_name"), F.count("*").alias("n_rows"), distinct(c).alias("n_distinct"), F.count_if(c.isNull()).alias("n_nulls"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"), text.alias("avg_length")))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, n): `buckets` equal steps between the least and the greatest value, the last one closed."""
    bounds = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    both = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").join(F.broadcast(bounds))  # one row of bounds
    step = (F.col("_hi") - F.col("_lo")) / buckets
    number = F.when(step == 0, F.lit(1)).otherwise(F.least(F.floor((F.col("v") - F.col("_lo")) / F.nullif(step, F.lit(0.0))) + 1, F.lit(buckets)))
    counted = both.groupBy(number.cast("bigint").alias("bucket"), "_lo", "_hi").agg(F.count("*").alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    return counted.select("bucket", (F.col("_lo") + (F.col("bucket") - 1) * width).alias("low"), (F.col("_lo") + F.col("bucket") * width).alias("high"), "n")


def plan_statistics(df: DataFrame) -> dict:
    """What the optimizer did to a query: nodes before and after, pushed filters, columns read, estimated size."""
    q = df._jdf.queryExecution()
    nodes = lambda p: sum(1 for line in p.toString().splitlines() if line.strip())
    physical = q.executedPlan().toString()
    return {
        "analyzed_nodes": nodes(q.analyzed()),
        "optimized_nodes": nodes(q.optimizedPlan()),
        "pushed_filters": physical.count("PushedFilters: [") - physical.count("PushedFilters: []"),
        "exchanges": physical.count("Exchange"),
        "estimated_bytes": int(str(q.optimizedPlan().stats().sizeInBytes())),
    }
