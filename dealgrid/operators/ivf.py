"""Approximate top-k cosine: an inverted file of cells (centres fitted on a sample).

Every vector of the corpus belongs to the cell of its nearest centre, and the index table is
written by cell.  A question meets only the cells of its ``probes`` nearest centres, where the
similarities are exact; the best k of all probed cells are its hits.  Work grows with questions
x probed cells instead of questions x corpus, and so does the shuffle.

* Centres are fitted with Spark ML on at most ``SAMPLE_ROWS`` vectors; there are at most
  ``MAX_CELLS`` of them, so the matrix that goes to the tasks has a known bound.
* A cell of more than ``PART_ROWS`` vectors is cut into parts, and its questions into blocks of
  as many, which meet in different tasks: a hot cell is no hot task.  The plan table of parts
  has one row per cell.
* How many cells must be probed depends on the data: vectors in clear groups need a few, vectors
  without any need half of them.  ``probes_for`` finds the number from the exact neighbours of
  a bounded sample of rows: the cells of the wanted share of them must be within reach.
* A task gets blocks of vectors and leaves k candidates a question: no pair row exists.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dealgrid.operators.retrieval import _block_pair, topk_cosine
from dealgrid.schemas import TOP_K
from dealgrid.session import scratch_path
from dealgrid.sources.files import write_parquet

# The functions of this module travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
PART_ROWS = 8192
SAMPLE_QUESTIONS = 256


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector) of the rows that can be compared: an id, and a finite vector other than zero."""
    v = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    square = F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x)
    return v.where(F.col("_id").isNotNull() & F.col("_vec").isNotNull() & F.coalesce((square > 0) & (square < float("inf")), F.lit(False)))


def fit_centres(vectors: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", cells: int | None = None,
                sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Unit centres, one row each.  ``cells`` defaults to the square root of the rows (at most
    MAX_CELLS); the sample is the ``sample_rows`` usable vectors of smallest id hash, so it does
    not depend on how the table is cut.  Vectors must have one length."""
    rows = _usable(vectors, id_col, vec_col)
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "_id"), F.xxhash64("_vec")).limit(sample_rows)
    k = min(cells or max(1, round(n ** 0.5)), MAX_CELLS, n, sample_rows)
    if k == 1:
        return np.ones((1, len(rows.first()["_vec"])))
    kmeans = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=15, featuresCol="v")
    centres = np.array(kmeans.fit(sample.select(array_to_vector("_vec").alias("v"))).clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def _nearest(centres: np.ndarray, probes: int, schema: pa.Schema):
    """Each vector once for each of its nearest ``probes`` centres."""
    probes = min(probes, len(centres))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if v.shape[1] != centres.shape[1]:
                    raise ValueError(f"vectors of {v.shape[1]} entries, centres of {centres.shape[1]}")
                near = v @ centres.T
                cell = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(centres) \
                    else np.tile(np.arange(len(centres)), (len(v), 1))
                at = pa.array(np.repeat(np.arange(len(v)), probes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cell.reshape(-1), pa.int32())], schema=schema)
    return run


def assign(vectors: DataFrame, centres: np.ndarray, probes: int = 1, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, _vec, cell): every usable vector with its nearest cell, or its ``probes`` nearest.
    Vectors of another length than the centres' fail the job."""
    rows = _usable(vectors, id_col, vec_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    if not len(centres):
        return rows.withColumn("cell", F.lit(0)).limit(0)
    return rows.mapInArrow(_nearest(centres, probes, to_arrow_schema(schema)), schema)


def build_index(vectors: DataFrame, centres: np.ndarray, path: str, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The corpus with its cells, written in one folder per cell: a search that probes few cells
    reads few folders.  Rows of a cell are spread over as many files as its parts."""
    rows = assign(vectors, centres, 1, id_col, vec_col)
    spread = F.pmod(F.xxhash64("_id", "_vec"), F.lit(16))
    rows.repartition("cell", spread).write.mode("overwrite").partitionBy("cell").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def search(questions: DataFrame, index: DataFrame, centres: np.ndarray, k: int = TOP_K, probes: int = 8,
           q_id: str = "question_id", q_vec: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(question_id, chunk_id, similarity, rank): the k most similar rows of the probed cells
    (12 places, ties by chunk id).  Questions and rows without an id or a usable vector give no
    hit; an id that repeats counts once with its best vector; empty sides give no rows."""
    spark = index.sparkSession
    path = scratch_path(spark, "ivf-questions")
    write_parquet(assign(questions, centres, probes, q_id, q_vec), path)
    asked = spark.read.parquet(path).withColumnRenamed("_id", "_qid")
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias(name))
    plan = parts(index, "_nc").join(parts(asked, "_nq"), "cell")  # one row per cell: MAX_CELLS at most
    q = (asked.join(F.broadcast(plan), "cell").withColumn("_i", F.pmod(F.xxhash64("_qid", "_vec"), F.col("_nq")).cast("int"))
         .withColumn("_j", F.explode(F.expr("sequence(0, _nc - 1)"))).select("_qid", "_vec", "cell", "_i", "_j"))
    c = (index.withColumnRenamed("_id", "_cid").join(F.broadcast(plan), "cell")
         .withColumn("_j", F.pmod(F.xxhash64("_cid", "_vec"), F.col("_nc")).cast("int"))
         .withColumn("_i", F.explode(F.expr("sequence(0, _nq - 1)"))).select("_cid", "_vec", "cell", "_i", "_j"))
    schema = T.StructType([T.StructField("_qid", asked.schema["_qid"].dataType),
                           T.StructField("_cid", index.schema["_id"].dataType), T.StructField("_sim", T.DoubleType())])
    keys = [F.size("_vec").alias("_dim"), "cell", "_i", "_j"]
    near = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_block_pair(k, exclude_self, to_arrow_schema(schema)), schema)
    best = Window.partitionBy("_qid").orderBy(F.col("_sim").desc(), F.col("_cid").asc())
    return (near.groupBy("_qid", "_cid").agg(F.max("_sim").alias("_sim")).withColumn("rank", F.row_number().over(best).cast("int"))
            .where(F.col("rank") <= k).select(F.col("_qid").alias("question_id"), F.col("_cid").alias("chunk_id"),
                                              F.col("_sim").alias("similarity"), "rank"))


def probes_for(index: DataFrame, centres: np.ndarray, k: int = TOP_K, target: float = 0.95,
               sample_questions: int = SAMPLE_QUESTIONS, seed: int = 7) -> int:
    """Cells to probe so that ``target`` of the exact k neighbours of the sampled rows (those of
    smallest id hash) lie in them.  One exact search of at most ``sample_questions`` questions."""
    if len(centres) < 2:
        return 1
    sample = index.select(F.col("_id").alias("question_id"), F.col("_vec").alias("embedding")).orderBy(
        F.xxhash64(F.lit(seed), "_id"), F.xxhash64("_vec")).limit(sample_questions)
    path = scratch_path(index.sparkSession, "ivf-sample")
    write_parquet(sample, path)
    sample = index.sparkSession.read.schema(sample.schema).parquet(path)
    near = topk_cosine(sample, index, k, c_id="_id", c_vec="_vec", exclude_self=True)
    path = scratch_path(index.sparkSession, "ivf-near")
    write_parquet(near.select("question_id", "chunk_id"), path)
    near = index.sparkSession.read.parquet(path)
    # At most sample_questions * k rows, whatever the corpus.
    rows = near.join(index.select(F.col("_id").alias("chunk_id"), "cell"), "chunk_id").join(sample, "question_id").select(
        "embedding", "cell").toArrow()
    if not rows.num_rows:
        return len(centres)
    v = np.array(rows["embedding"].to_pylist())
    close = v @ centres.T
    own = close[np.arange(len(v)), rows["cell"].to_numpy()]
    return int(np.ceil(np.quantile((close > own[:, None]).sum(axis=1) + 1, target)))


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """(questions, wanted, found, recall): share of the exact hits that are among ``hits``; a hit
    as similar as the last exact one of its question counts, whatever its id (ties)."""
    last = exact.groupBy("question_id").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
    good = hits.join(last, "question_id").where("similarity >= least").groupBy("question_id").agg(F.count("*").alias("hit"))
    each = last.join(good, "question_id", "left").select("n", F.least("n", F.coalesce("hit", F.lit(0))).alias("hit"))
    return each.agg(F.count("*").alias("questions"), F.sum("n").alias("wanted"), F.sum("hit").alias("found")).withColumn(
        "recall", F.col("found") / F.nullif("wanted", F.lit(0)))


def index_and_search(spark: SparkSession, corpus: DataFrame, questions: DataFrame, k: int = TOP_K, probes: int | None = None,
                     cells: int | None = None, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index, hits): fit, index all rows of (chunk_id, embedding) and ask (question_id,
    embedding), with as many probes as ``probes_for`` says unless given."""
    centres = fit_centres(corpus, cells=cells)
    index = build_index(corpus, centres, scratch_path(spark, "ivf-index"))
    probes = probes or probes_for(index, centres, k)
    return index, search(questions, index, centres, k, probes, exclude_self=exclude_self)
