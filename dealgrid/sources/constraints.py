"""Rows that the tables' constraints admit, as a plan per table: NOT NULL columns, foreign
keys into admitted rows, and the first row of each primary key in file order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.schemas import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS
from dealgrid.session import scratch_path


def judged(rows: DataFrame, name: str, parents: Callable[[str], DataFrame]) -> DataFrame:
    """``rows`` (columns of table ``name`` and ``at``, an orderable place) with ``reasons``,
    empty for the rows admitted.

    A row is judged as an insert would be, in file order: required values, then parents
    (``parents(table)`` gives that table's admitted rows), then its key, which the first
    row without another fault takes.  Of rows with one key and one place, all but one are
    not told apart.  Only keys are shuffled: those without a parent, and those found twice, are
    written, so that their measured size decides how they meet the rows.  ``rows`` is read
    once a key and once for the result: give a written table.
    """
    spark = rows.sparkSession

    def written(keys: DataFrame, what: str) -> DataFrame:
        store = scratch_path(spark, f"judged-{name}-{what}")
        keys.write.parquet(store)
        return spark.read.schema(keys.schema).parquet(store)

    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in NOT_NULL[name]]))
    out, faults = rows, [missing]
    for column, parent in FOREIGN_KEYS.get(name, []):
        key = parents(parent).select(F.col(PRIMARY_KEYS[parent]).alias(f"__{column}"))
        lost = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(f"__{column}")).distinct()
        lost = written(lost.join(key, f"__{column}", "left_anti"), column)
        out = out.join(lost, F.col(column) == F.col(f"__{column}"), "left")
        faults.append(F.array_compact(F.array(F.when(F.col(f"__{column}").isNotNull(), F.lit(f"{column} is not in {parent}")))))
    key = PRIMARY_KEYS[name]
    out = out.select(*rows.columns, F.concat(*faults).alias("__faults"))
    twice = (out.where(F.size("__faults") == 0).groupBy(F.col(key).alias("__key"))
             .agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    out = out.join(written(twice, key), F.col(key) == F.col("__key"), "left")
    again = (F.size("__faults") == 0) & F.col("__first").isNotNull() & (F.col("at") != F.col("__first"))
    return out.select(*rows.columns, F.when(again, F.array(F.lit(f"{key} repeats"))).otherwise(F.col("__faults")).alias("reasons"))
