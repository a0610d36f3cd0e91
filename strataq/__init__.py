"""strataq: a Spark-first analytics engine (SQL, catalog, row index, DataFrame verbs)."""
