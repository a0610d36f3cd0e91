"""Connected components of a distributed link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


MAX_BROADCAST_ROWS = 200_000


def attach(big: DataFrame, small: DataFrame, key: str, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """big with the columns of small, which is written and has one row for each key.

    A small table is broadcast behind a count of its rows, so a hot key stays where its rows are; beyond `most` rows it is a
    shuffled join, whose hot partitions adaptive execution splits.
    """
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, key)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a long, b long): component is the smallest node reachable.

    Each round rewires links towards smaller nodes, until nothing but stars is left; the table never grows beyond its first
    size, rounds grow with the logarithm of a component's size, and nothing but one count reaches the driver. Large hubs are
    combined on the map side, and the joins by hub are plain joins, whose hot partitions adaptive execution splits.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        # large star: each node's larger neighbours move to its smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = links.select(F.col("u").alias("x"), F.col("v").alias("u")).join(least, "u").select(F.col("x").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours move to the smallest of them
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.filter("u <> v").distinct(), "links")
        # done when every node hangs on a root: no node is both above one and below another
        if after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0 and _stars(after):
            links = after
            break
        links = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """True if no node hangs on two roots."""
    return links.groupBy("u").count().filter("count > 1").limit(1).count() == 0
