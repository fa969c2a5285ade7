"""CSV and parquet sources/sinks for the CRM tables.

Writers overwrite (full refresh, idempotent) or append; readers apply the
table schema and parse dates leniently (unparseable -> NULL, time part dropped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealgrid.schemas import DATE_COLUMNS, TABLE_SCHEMAS
from dealgrid.sources.csv_records import csv_records

LOAD_ORDER = ["reps", "leads", "deals", "engagement", "customers"]


# Quoted fields may hold line breaks, commas and doubled quotes.  ``csv_records`` reads
# such files in splits.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, no index column; dates as ISO text; quotes doubled inside a field."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Header CSV of a CRM table.  Dates are lenient (a bad value becomes NULL); any
    other value that does not fit its type, or a row with missing or extra fields,
    fails the job.  ``read_checked`` sets such rows aside instead."""
    rows, bad = _parsed(spark, path, name)
    broken = F.raise_error(F.concat(F.lit(f"{name}: "), F.array_join(bad, ", ")))
    first = TABLE_SCHEMAS[name].fields[0]
    return rows.select(F.when(F.size(bad) > 0, broken).otherwise(F.col(f"parsed.{first.name}")).cast(first.dataType)
                       .alias(first.name), *[F.col(f"parsed.{f.name}") for f in TABLE_SCHEMAS[name].fields[1:]])


def read_checked(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the table, rejects): like ``read_table``, but a row that does not fit is
    a reject ``(row: the fields as text, reasons: array<string>)``."""
    rows, bad = _parsed(spark, path, name)
    return (rows.where(F.size(bad) == 0).select("parsed.*"),
            rows.where(F.size(bad) > 0).select("row", bad.alias("reasons")))


def read_placed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(at, row, parsed, reasons): every record with its place in file order, its fields as
    text, typed, and what does not fit."""
    rows, bad = _parsed(spark, path, name)
    return rows.select("at", "row", "parsed", bad.alias("reasons"))


def _parsed(spark: SparkSession, path: str, name: str):
    """Rows as text (``row``) and typed (``parsed``), and a column of what does not fit."""
    fields, dates = TABLE_SCHEMAS[name].fields, set(DATE_COLUMNS[name])
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields]
                        + [T.StructField("_corrupt_record", T.StringType())])
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"mode": "PERMISSIVE"}
    df = (csv_records(spark, path).select("at", "closed", F.from_csv("record", text.simpleString(), options).alias("r"))
          .select("at", "closed", "r.*"))
    typed = {f.name: F.to_date(F.try_to_timestamp(F.trim(F.col(f.name)))) if f.name in dates
             else F.col(f.name) if isinstance(f.dataType, T.StringType)
             else F.col(f.name).try_cast(f.dataType) for f in fields}
    bad = [F.when(~F.col("closed"), F.lit("a quote is never closed")),
           F.when(F.col("_corrupt_record").isNotNull(), F.lit("wrong number of fields"))]
    bad += [F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), F.lit(f"{f.name} is not {f.dataType.simpleString()}"))
            for f in fields if f.name not in dates and not isinstance(f.dataType, T.StringType)]
    rows = df.select("at", F.struct(*[F.col(f.name) for f in fields]).alias("row"),
                     F.struct(*[typed[f.name].alias(f.name) for f in fields]).alias("parsed"),
                     F.array_compact(F.array(*bad)).alias("_bad"))
    return rows, F.col("_bad")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace (or append to) a table; the schema travels with the data."""
    df.write.mode(mode).parquet(path)


def full_refresh(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> DataFrame:
    """Write every CRM table (previous rows dropped) in load order and report
    (table_name, rows) counted from what was written."""
    parts = None
    for name in LOAD_ORDER:
        path = f"{out.rstrip('/')}/{name}"
        write_parquet(tables[name], path)
        part = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def reconcile(source: dict[str, DataFrame], loaded: dict[str, DataFrame]) -> DataFrame:
    """(table_name, source_rows, loaded_rows, ok) per table."""
    out = None
    for name in source:
        s = source[name].agg(F.count(F.lit(1)).alias("source_rows"))
        d = loaded[name].agg(F.count(F.lit(1)).alias("loaded_rows"))
        part = s.select(F.lit(name).alias("table_name"), "source_rows",
                        d.select("loaded_rows").scalar().alias("loaded_rows"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ok", F.col("source_rows") == F.col("loaded_rows"))


BUCKET_KEYS = {"deals": "deal_id", "engagement": "deal_id"}


def write_bucketed(spark: SparkSession, tables: dict[str, DataFrame], base: str,
                   n_buckets: int, prefix: str) -> dict[str, DataFrame]:
    """Write the CRM tables as external tables under ``base``; deals and
    engagement are bucketed and sorted by deal_id into the same number of
    buckets, so joins and per-deal aggregations between them need no shuffle.
    Returns the tables read back from the catalog."""
    out = {}
    for name, df in tables.items():
        table = f"{prefix}_{name}"
        w = df.write.mode("overwrite").option("path", f"{base.rstrip('/')}/{name}")
        if name in BUCKET_KEYS:
            w = w.bucketBy(n_buckets, BUCKET_KEYS[name]).sortBy(BUCKET_KEYS[name])
        w.format("parquet").saveAsTable(table)
        out[name] = spark.table(table)
    return out
