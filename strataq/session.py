"""SparkSession factory with the engine's defaults.

Only runtime defaults that hold at every size are fixed here: UTC, ANSI, adaptive execution. Partition counts stay with
the cluster (AQE coalesces or splits from the advisory size), the local default merely avoids 200 tiny tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "strataq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` wins. `master` is only for tests and local tools."""
    builder = SparkSession.builder.appName(app)
    if master:
        cpus = master.partition("[")[2].rstrip("]")
        builder = builder.master(master).config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else str(os.cpu_count()))
        builder = builder.config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
