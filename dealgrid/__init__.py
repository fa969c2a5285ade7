"""dealgrid: B2B sales analytics as Spark DataFrame, SQL and Spark ML jobs.

Modules
-------
sources     given tables -> CRM views; CSV/parquet readers and writers
functions   column-expression helpers (exact rounding, enum flags, Python-equal whitespace)
operators   quality, features, metrics, ranking, presentation, retrieval, ml, insights
plans       query registry (name -> callable(spark, sf_dir)) and DuckDB oracle texts
"""
