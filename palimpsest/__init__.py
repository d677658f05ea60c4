"""A memoizing batch-query engine on PySpark."""
