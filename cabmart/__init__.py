"""cabmart: a trip-analytics warehouse written as Spark DataFrame jobs.

Layers: ``sources`` (scans and stand-in roles), ``functions`` (column
expressions), ``operators`` (table-level building blocks: dedup, lookups,
surrogate keys, incremental loads, SCD2, quality checks), ``plans`` (the
ODS / datamart models and the report queries) and ``streaming`` (the same
incremental loads driven by Structured Streaming micro-batches).
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
