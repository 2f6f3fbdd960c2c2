"""Composed plans: the three pipeline phases, the query
registry used by ``__spark_entry__`` and its DuckDB oracle SQL."""
