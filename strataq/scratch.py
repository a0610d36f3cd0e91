"""Tables that cut lineage, kept in the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, list[str]] = {}
_tables: dict[tuple, list[str]] = {}
_shipped: set[str] = set()


def _owner(spark: SparkSession) -> tuple:
    """This application and thread."""
    return spark.sparkContext.applicationId, threading.get_ident()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder stands in only where it is unset and the master is local."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='strataq-')}")
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, remembered as this application's."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(_owner(spark), []).append(path)
    return path


def remember_table(spark: SparkSession, table: str) -> None:
    """A table of the session catalog that `drop_scratch` is to drop."""
    _tables.setdefault(_owner(spark), []).append(table)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and reads it back: later jobs start from files that survive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> tuple[int, int]:
    """How much this thread of the application has written so far; `drop_scratch` can spare what came before."""
    app = _owner(spark)
    return len(_written.get(app, [])), len(_tables.get(app, []))


def drop_scratch(spark: SparkSession, since: tuple[int, int] = (0, 0), keep: DataFrame | None = None) -> None:
    """Deletes the tables that this thread of the application wrote (after `since`), and nothing else in the shared folder.

    `keep` names a DataFrame whose files stay. Call it once the results that read the tables have been written or read.
    """
    app = _owner(spark)
    held = "\n".join(keep.inputFiles()) if keep is not None else ""
    for table in _tables.get(app, [])[since[1] :]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = _written.get(app, [])[: since[0]]
    for where in _written.get(app, [])[since[0] :]:
        if where.rpartition("/")[2] in held:
            left.append(where)
            continue
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)
    _written[app], _tables[app] = left, _tables.get(app, [])[: since[1]]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, so that they need no copy on their own paths."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # the driver serves this file to the workers for as long as the application runs
    folder = tempfile.mkdtemp(prefix="strataq-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "strataq_package.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
