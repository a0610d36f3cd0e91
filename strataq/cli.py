"""A small shell: SQL statements, and commands that begin with a backslash.

    python -m strataq.cli DATA_FOLDER
    \\dt [pattern]  tables      \\d NAME  describe a table     \\dn  schemas    \\dc  catalogs
    \\l  data files             \\json SQL  result as JSON     \\stats  cache figures     \\q  leave
"""

from __future__ import annotations

import sys

from .plans.engine import Engine
from .sources.catalog import Catalog


def answer(engine: Engine, line: str) -> str | None:
    """What the shell prints for a line; None to leave."""
    line = line.strip().rstrip(";")
    command, _, rest = line.partition(" ")
    if command == "\\q":
        return None
    if command == "\\dt":
        return "\n".join(engine.catalog.tables(rest.strip() or "*"))
    if command == "\\dn":
        return "\n".join(engine.catalog.schemas())
    if command == "\\dc":
        return "\n".join(engine.catalog.catalogs())
    if command == "\\d":
        return engine.table_info(rest.strip())
    if command == "\\l":
        path = engine.spark._jvm.org.apache.hadoop.fs.Path(engine.data_path)
        listed = path.getFileSystem(engine.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return "\n".join(sorted(s.getPath().getName() for s in listed))
    if command == "\\json":
        return engine.execute_to_json(rest)
    if command == "\\stats":
        return "\n".join(f"{k}: {v}" for k, v in engine.cache.stats().items())
    return engine.execute_to_table(line) if line else ""


def main() -> None:
    from .session import build_session

    spark = build_session("strataq shell", "local[*]")
    engine = Engine(spark, data_path=sys.argv[1] if len(sys.argv) > 1 else ".", catalog=Catalog(spark))
    while (line := input("strataq> ")) is not None:
        try:
            text = answer(engine, line)
        except Exception as e:  # a shell shows errors and goes on
            text = f"error: {e}"
        if text is None:
            break
        print(text)


if __name__ == "__main__":
    main()
