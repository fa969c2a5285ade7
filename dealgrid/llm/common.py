"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dealgrid.session import scratch_path

# A side is broadcast only if its counted rows take at most this many bytes;
# beyond it the same join runs as a shuffle join.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a
    lost executor costs nothing but a new read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` hinted for broadcast if its counted rows fit BROADCAST_BYTES, else as it
    is (a shuffle join).  ``df`` should be a written table: it is read once to count."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def in_tasks(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` in tasks: its fields are broadcast, its class travels with
    the function, so workers need no copy of the package."""
    if value is None:
        return lambda: None
    fields, cls = spark.sparkContext.broadcast(vars(value)), type(value)

    def get():
        made = cls.__new__(cls)
        made.__dict__.update(fields.value)
        return made
    return get


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text: whatever other columns are called, they cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
