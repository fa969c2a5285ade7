"""Records of quoted CSV files whose fields may hold line breaks, read by many tasks a file.

A line break ends a record only where the number of quotes before it is even.  Each split
counts its own quotes; a running sum over the splits of a file (one small row each) tells
every split whether it begins inside a quoted field, and where the record began that it
continues.  Lines that are whole records stay in the scan; only the lines of records with
line breaks are shuffled, by the place where their record begins.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrid.session import scratch_path

# Worker functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLITS = "file string, block long, odd boolean, opener_even long, opener_odd long"
LINES = ("file string, block long, line long, value string, inside boolean, odd boolean, "
         "opener_even long, opener_odd long")


def _scan(batches):
    """(batch, lo, hi, line, inside, odd, opener_even, opener_odd) for each run of lines of
    one split in a batch.  ``inside``: an odd number of quotes stands before the line in its
    split.  An opener is the last line up to here with an odd number of quotes before which
    the split has an even (odd) number; -1 if there is none."""
    at, line, quotes, openers = None, 0, 0, [-1, -1]
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
        own = np.asarray(batch.column(2)).astype(np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            place = (batch.column(0)[lo].as_py(), int(blocks[lo]))
            if place != at:
                at, line, quotes, openers = place, 0, 0, [-1, -1]
            total = quotes + np.cumsum(own[lo:hi])
            inside, odd = (total - own[lo:hi]) % 2 == 1, own[lo:hi] % 2 == 1
            number = line + np.arange(hi - lo)
            last = [np.maximum.accumulate(np.concatenate(([openers[p]], np.where(odd & (inside == bool(p)), number, -1))))[1:]
                    for p in (0, 1)]
            yield batch, lo, hi, number, inside, odd, last[0], last[1]
            line, quotes, openers = line + hi - lo, int(total[-1]), [int(x[-1]) for x in last]


def _split_rows(batches):
    at, row = None, None
    for batch, lo, _, _, inside, odd, even_at, odd_at in _scan(batches):
        place = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py())
        if place != at and row is not None:
            yield _one(row)
        at, row = place, (*place, bool(inside[-1] ^ odd[-1]), int(even_at[-1]), int(odd_at[-1]))
    if row is not None:
        yield _one(row)


def _one(row):
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                      ["file", "block", "odd", "opener_even", "opener_odd"])


def _line_rows(batches):
    for batch, lo, hi, number, inside, odd, even_at, odd_at in _scan(batches):
        part = batch.slice(lo, hi - lo)
        yield pa.RecordBatch.from_arrays(
            [pc.cast(part.column(0), pa.string()), part.column(1), pa.array(number), pc.cast(part.column(3), pa.string()),
             pa.array(inside), pa.array(odd), pa.array(even_at), pa.array(odd_at)],
            ["file", "block", "line", "value", "inside", "odd", "opener_even", "opener_odd"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    quotes.cast("long").alias("quotes"), "value"))


def _content(records: DataFrame) -> DataFrame:
    """Without headers, blank lines and the ``\\r`` before the line break that ends a record."""
    records = records.withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.where("not (at.block = 0 and at.line = 0) and (record is null or record <> '')")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(at: struct(file, block, line), record, closed) of the CSV files at ``path``.

    ``at`` is the place where the record begins; its order is file order.  The first record
    of each file is its header and left out, blank lines too; ``\\r`` before the line break
    that ends a record is cut.  A quote stands for itself only doubled inside a quoted field.
    If a file's last quoted field is never closed, that record has ``closed`` false and its
    text is null: all that follows the open quote belongs to it, and is not gathered.
    """
    lines = _lines(spark, path)
    splits = lines.select("file", "block", "quotes").mapInArrow(_split_rows, SPLITS)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.col("odd").cast("int")).over(before) % 2 == 1, F.lit(False))
    splits = splits.withColumn("begins_inside", begins)
    opener = F.when(F.col("begins_inside"), F.col("opener_odd")).otherwise(F.col("opener_even"))
    splits = splits.select("file", "block", "begins_inside", "odd", (F.greatest("opener_even", "opener_odd") >= 0).alias("breaks"),
                           F.when(opener >= 0, F.struct("block", opener.alias("line"))).alias("opener"))
    whole_file = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    splits = splits.select(
        F.col("file").alias("s_file"), F.col("block").alias("s_block"), "begins_inside", "breaks",
        F.last("opener", True).over(before).alias("continues"),
        F.when(F.sum(F.col("odd").cast("int")).over(whole_file) % 2 == 1, F.last("opener", True).over(whole_file)).alias("unclosed"))
    # Written: its measured size decides how it is joined.
    store = scratch_path(spark, "csv-splits")
    splits.write.parquet(store)
    splits = spark.read.schema(splits.schema).parquet(store)

    placed = lines.mapInArrow(_line_rows, LINES).join(
        splits, (F.col("file") == F.col("s_file")) & (F.col("block") == F.col("s_block")), "left")
    known = F.when(F.col("s_file").isNull(), F.raise_error(F.lit("the splits of the files changed while they were read"))
                   ).otherwise(F.col("begins_inside"))
    placed = placed.withColumn("continued", F.col("inside") != known)
    opener = F.when(F.col("begins_inside"), F.col("opener_odd")).otherwise(F.col("opener_even"))
    own = F.struct("block", "line")
    begin = F.when(~F.col("continued"), own).when(opener >= 0, F.struct("block", opener.alias("line"))).otherwise(F.col("continues"))
    placed = placed.select("file", "block", "line", "value", "unclosed", begin.alias("begin"),
                           (~F.col("continued") & ~F.col("odd")).alias("whole"))
    at = F.struct("file", F.col("begin.block").alias("block"), F.col("begin.line").alias("line")).alias("at")
    whole = placed.where("whole").select(at, F.col("value").alias("record"), F.lit(True).alias("closed"))
    if splits.where("breaks").isEmpty():  # no line has an odd number of quotes: every line is whole
        return _content(whole)
    # Written: two kinds of records are made of them.
    store = scratch_path(spark, "csv-parts")
    parts = placed.where("not whole")
    parts.write.parquet(store)
    parts = spark.read.schema(parts.schema).parquet(store)
    open_ended = F.col("begin").eqNullSafe(F.col("unclosed"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = (parts.where(~open_ended).groupBy("file", "begin").agg(pieces.alias("pieces"))
              .select(at, F.array_join("pieces.value", "\n").alias("record"), F.lit(True).alias("closed")))
    broken = (parts.where(open_ended & (F.struct("block", "line") == F.col("begin")))
              .select(at, F.lit(None).cast("string").alias("record"), F.lit(False).alias("closed")))
    return _content(whole.unionByName(joined).unionByName(broken))
