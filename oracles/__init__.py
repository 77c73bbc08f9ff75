"""DuckDB statements that state each query's result independently of the Spark jobs."""
