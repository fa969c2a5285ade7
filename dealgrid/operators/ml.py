"""Lead-conversion and deal-risk models with Spark ML.

Training data never leaves the cluster: features are assembled with
``VectorAssembler``, the split is an exact share of each class by a per-row hash
(independent of partitioning), class imbalance is a weight column, the model is ``GBTClassifier``.  Metric
formulas (AUC by rank sum, confusion counts) are aggregations, so they also
apply to any score column.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealgrid.functions.core import count_if, half_up_ratio
from dealgrid.operators.ranking import global_row_number
from dealgrid.session import scratch_path, shared_dir
from dealgrid.sources.versions import claim_version, list_versions, publish  # noqa: F401

# The functions of this module travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# FIXED VALUES: model settings (trees, depth, learning rate, row and column
# subsampling, seed, hold-out share) and the acceptance gate
GBT_PARAMS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8", "seed": 42}
TEST_SIZE = 0.20
SEED = 42
MIN_ROC_AUC = 0.70

# Trees between checkpoints of the boosting state (lineage cut; own setting).
CHECKPOINT_TREES = 10

# More training rows than this are merged where their features and label are equal, into at
# most so many weighted rows each (own settings).
MERGE_ROWS = 1 << 20
SHARES = 64


def feature_matrix(features: DataFrame, feature_cols: list[str], label: str,
                   id_col: str) -> DataFrame:
    """(id, features vector, label) with the columns in model order."""
    missing = [c for c in feature_cols + [label] if c not in features.columns]
    if missing:
        raise ValueError(f"Missing expected feature columns: {missing}")
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="error")
    return va.transform(features.select(id_col, label, *feature_cols)).select(
        id_col, "features", F.col(label).cast("double").alias("label"))


HASH_BITS = 60
DIGIT_BITS = 12  # 4,096 counts per class and pass


def split_hash(id_col: str, seed: int = SEED) -> Column:
    """60 bits of md5("seed:id") as a non-negative long, the same in every engine; a null id
    hashes as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _class_cuts(hashed: DataFrame, parts: int) -> DataFrame:
    """(_y, _cut): per class the hash of the row that fills its share (``parts`` ten
    thousandths of its rows, half up), found exactly by descending into one bucket of
    ``DIGIT_BITS`` more hash bits a pass.  Every pass leaves at most 4,096 counts per class."""
    state = None
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        bucket = F.shiftright("_h", shift)
        if state is None:
            counts = hashed.groupBy("_y", bucket.alias("_d")).agg(F.count(F.lit(1)).alias("_c")).withColumn(
                "_rows", F.sum("_c").over(Window.partitionBy("_y"))).withColumn(
                "_need", F.expr(f"(_rows * {parts} + 5000) div 10000"))
        else:
            # one row per class of the label
            inside = hashed.join(F.broadcast(state), hashed._y.eqNullSafe(state._class)
                                 & (F.shiftright("_h", shift + DIGIT_BITS) == F.col("_d0")))
            counts = inside.groupBy("_y", "_need", bucket.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_y").orderBy("_d"))
        state = counts.withColumn("_upto", upto).where("_upto >= _need and _upto - _c < _need").select(
            F.col("_y").alias("_class"), (F.col("_need") - F.col("_upto") + F.col("_c")).alias("_need"),
            F.col("_d").alias("_d0"))
    return state.select(F.col("_class").alias("_y"), F.col("_d0").alias("_cut"))


def stratified_split(df: DataFrame, id_col: str, test_size: float = TEST_SIZE,
                     seed: int = SEED, label: str | None = None) -> DataFrame:
    """Adds ``is_test`` from a hash of (seed, id), so a row's side does not depend
    on partitioning or order.  Without ``label`` the cut is the fixed share of
    the hash range (each class gets the share in expectation).  With ``label`` the rows of
    each class whose rank by hash is at most the class's share (``test_size`` of its rows,
    rounded half up) are test rows: exactly that many, except that rows with one id stay
    together.  A null label is a class of its own.  The cuts, one row per class, are
    broadcast: ``label`` must be a class label, not a measure."""
    parts = int(round(test_size * 10000))
    if label is None:
        return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(10000)) < parts)
    h = split_hash(id_col, seed)
    cuts = _class_cuts(df.select(F.col(label).alias("_y"), h.alias("_h")), parts).select(
        F.col("_y").alias("__class"), F.col("_cut").alias("__cut"))
    j = df.withColumn("__h", h).join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("__class")), "left")
    return j.withColumn("is_test", F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False))).drop(
        "__h", "__class", "__cut")


def with_class_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """Positives weighted negatives/positives (scale_pos_weight), negatives 1."""
    w = train.agg((count_if(F.col(label) == 0).cast("double")
                   / F.nullif(count_if(F.col(label) == 1), F.lit(0)).cast("double"))).scalar()
    return train.withColumn("weight", F.when(F.col(label) == 1, F.coalesce(w, F.lit(1.0)))
                            .otherwise(F.lit(1.0)))


def merged_rows(train: DataFrame, id_col: str, above: int = MERGE_ROWS) -> DataFrame:
    """Rows of equal features, label and share (a hash of the id, ``SHARES`` of them) as one row of
    their summed weight, written.  The trees see only features, label and weight, so every row
    counts as before; the subsample of a tree takes shares instead of single rows.  Up to ``above``
    rows, or if fewer than half of them go, ``train`` is returned as it is."""
    rows = train.count()
    if rows <= above:
        return train
    share = F.pmod(F.xxhash64(id_col), F.lit(SHARES)).alias("__share")
    merged = train.groupBy("features", "label", "weight", share).agg(F.count(F.lit(1)).alias("__n")).select(
        "features", "label", (F.col("weight") * F.col("__n")).alias("weight"))
    merged = _written(merged, scratch_path(train.sparkSession, "merged"))
    return merged if 2 * merged.count() <= rows else train


def train_gbt(train: DataFrame, params: dict | None = None) -> PipelineModel:
    """Boosting keeps the running predictions of all rows as an RDD updated per
    tree; with the shared checkpoint folder set, Spark checkpoints it every
    ``checkpointInterval`` trees, so 200 trees never build a 200-step lineage
    and a lost executor recomputes at most that many trees."""
    shared_dir(train.sparkSession)
    p = dict(GBT_PARAMS, **(params or {}))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                        checkpointInterval=CHECKPOINT_TREES, **p)
    return Pipeline(stages=[gbt]).fit(train)


def predict(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    """(id, label?, score): probability of class 1 rounded to 4 places."""
    out = model.transform(df)
    keep = [id_col] + (["label"] if "label" in df.columns else [])
    return out.select(*keep, F.round(vector_to_array("probability")[1], 4).alias("score"))


def _negatives_below(batches):
    """Per range partition (distinct scores sorted ascending): negatives with a
    lower score inside the partition, carried across Arrow batches."""
    carried = 0
    for pdf in batches:
        neg = pdf["neg"].to_numpy(dtype="int64")
        below = carried + np.cumsum(neg) - neg
        carried += int(neg.sum())
        yield pd.DataFrame({"_p": pdf["_p"].to_numpy(dtype="int32"),
                            "pos": pdf["pos"].to_numpy(dtype="int64"), "neg": neg,
                            "below": below.astype("int64")})


def auc_rank_sum(scored: DataFrame, score: str = "score", label: str = "label",
                 places: int | None = 4) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney; tied scores count one half), 6 places.

    Rows are first counted per distinct score (partial aggregation; scores
    taken to ``places`` decimals, or as they are with ``places=None``).  The
    negatives below each score are then a running sum over the distinct scores:
    for probabilities at up to 4 places there are at most 10,001 of them and one
    window takes them; otherwise (raw probabilities: as many distinct scores as
    rows) the distinct scores are range-partitioned, each partition holds a
    score interval, the running sum is taken inside the partitions and a
    partition's offset is the negatives of all lower partitions (one row per
    partition).  No task ever holds an unbounded number of scores."""
    s = F.round(score, places) if places is not None else F.col(score)
    per = scored.select(s.alias("_s"), F.col(label).alias("_y")).groupBy("_s").agg(
        count_if(F.col("_y") == 1).alias("pos"), count_if(F.col("_y") == 0).alias("neg"))
    if places is not None and places <= 4:
        w = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        j = per.select("pos", "neg", F.coalesce(F.sum("neg").over(w), F.lit(0)).alias("_below"))
    else:
        local = (per.repartitionByRange("_s").sortWithinPartitions("_s")
                 .select(F.spark_partition_id().alias("_p"), "pos", "neg")
                 .mapInPandas(_negatives_below, "_p int, pos long, neg long, below long"))
        totals = local.groupBy("_p").agg(F.sum("neg").alias("_n"))
        w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        # one row per partition: bounded by the partition count, safe to broadcast
        offsets = totals.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
        j = local.join(F.broadcast(offsets), "_p").select(
            "pos", "neg", (F.col("_off") + F.col("below")).alias("_below"))
    wide = "decimal(38,0)"
    agg = j.agg(F.sum(F.col("pos").cast(wide) * (2 * F.col("_below").cast(wide) + F.col("neg")))
                .alias("_num"),
                F.sum("pos").cast(wide).alias("_p"), F.sum("neg").cast(wide).alias("_n"))
    return agg.select(half_up_ratio("_num", "2 * _p * _n", 6).alias("roc_auc"))


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                   threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 of class 1 at ``score > threshold`` (0 when undefined), 4 places."""
    pred = F.col(score) > threshold
    y = F.col(label) == 1
    agg = scored.agg(count_if(pred & y).alias("tp"), count_if(pred & ~y).alias("fp"),
                     count_if(~pred & y).alias("fn"), count_if(~pred & ~y).alias("tn"))
    return agg.select("tp", "fp", "fn", "tn",
                      F.coalesce(half_up_ratio("tp", "tp + fp", 4), F.lit(0.0)).alias("precision"),
                      F.coalesce(half_up_ratio("tp", "tp + fn", 4), F.lit(0.0)).alias("recall"),
                      F.coalesce(half_up_ratio("2 * tp", "2 * tp + fp + fn", 4), F.lit(0.0)).alias("f1"))


def classification_report(scored: DataFrame, score: str = "score", label: str = "label",
                          names: tuple[str, str] = ("negative", "positive"),
                          threshold: float = 0.5) -> DataFrame:
    """Per class and macro / weighted averages: (class_name, precision, recall,
    f1_score, support), plus accuracy (precision = recall = f1 = accuracy)."""
    m = binary_metrics(scored, score, label, threshold)
    rows = m.select(
        F.lit(names[0]).alias("class_name"),
        F.coalesce(half_up_ratio("tn", "tn + fn", 4), F.lit(0.0)).alias("precision"),
        F.coalesce(half_up_ratio("tn", "tn + fp", 4), F.lit(0.0)).alias("recall"),
        F.coalesce(half_up_ratio("2 * tn", "2 * tn + fn + fp", 4), F.lit(0.0)).alias("f1_score"),
        (F.col("tn") + F.col("fp")).alias("support"),
    ).unionByName(m.select(
        F.lit(names[1]).alias("class_name"), "precision", "recall", F.col("f1").alias("f1_score"),
        (F.col("tp") + F.col("fn")).alias("support")))
    tot = m.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
                   half_up_ratio("tp + tn", "tp + fp + fn + tn", 4).alias("acc"))
    acc = tot.select(F.lit("accuracy").alias("class_name"), F.col("acc").alias("precision"),
                     F.col("acc").alias("recall"), F.col("acc").alias("f1_score"),
                     F.col("n").alias("support"))
    avg = rows.agg(F.round(F.avg("precision"), 4).alias("precision"),
                   F.round(F.avg("recall"), 4).alias("recall"),
                   F.round(F.avg("f1_score"), 4).alias("f1_score"),
                   F.sum("support").alias("support")).select(F.lit("macro avg").alias("class_name"), "*")
    wavg = rows.agg(F.round(F.sum(F.col("precision") * F.col("support")) / F.sum("support"), 4).alias("precision"),
                    F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 4).alias("recall"),
                    F.round(F.sum(F.col("f1_score") * F.col("support")) / F.sum("support"), 4)
                    .alias("f1_score"),
                    F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class_name"), "*")
    return rows.unionByName(acc).unionByName(avg).unionByName(wavg).withColumn(
        "support", F.col("support").cast("long"))


def feature_importances(model: PipelineModel, feature_cols: list[str]) -> DataFrame:
    spark = SparkSession.getActiveSession()
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(feature_cols, imp)],
                                 "feature string, importance double")


ROWS_PER_RING = 1 << 16


def with_next_row(df: DataFrame, id_col: str, cols: list[str], seed: int = SEED, name: str = "__next") -> DataFrame:
    """Adds the ``cols`` of another row as a struct: rows are dealt by hash into rings of about
    65,536 rows, ordered there by (hash, id, ``cols``), and each takes the row after it, the last the first.
    No row gets its own values unless its ring has one row only, and every value is used once."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ring = F.pmod(F.col("__h"), F.greatest(F.lit(1).cast("long"), F.floor(n / F.lit(ROWS_PER_RING)).cast("long")))
    w = Window.partitionBy("__ring").orderBy("__h", id_col, *cols)
    row = F.struct(*cols)
    return df.withColumn("__h", split_hash(id_col, seed)).withColumn("__ring", ring).withColumn(
        name, F.coalesce(F.lead(row).over(w), F.first(row).over(w))).drop("__h", "__ring")


def permutation_importance(df: DataFrame, id_col: str, cols: list[str], label: str,
                           scorer: Callable[[DataFrame], DataFrame], seed: int = SEED) -> DataFrame:
    """(feature, base_auc, permuted_auc, importance): how much ROC-AUC a score loses when one
    column takes the values of other rows (``with_next_row``), 6 places.  ``scorer`` adds
    ``score`` (at most 4 places) to rows with ``cols``; it sees every row once per column and once unchanged,
    in one pass, and the counts per (column, score) are summed before they are shuffled.  Rows
    with a null label or score do not count.  No rows: no result rows."""
    moved = with_next_row(df.select(id_col, F.col(label).alias("label"), *cols), id_col, cols, seed)
    variants = [F.struct(F.lit(f).cast("string").alias("feature"),
                         *[(F.col(f"__next.{c}") if c == f else F.col(c)).alias(c) for c in cols]) for f in [None, *cols]]
    rows = moved.select(id_col, "label", F.explode(F.array(*variants)).alias("__v")).select(id_col, "label", "__v.*")
    per = scorer(rows).where("score is not null").groupBy("feature", "score").agg(
        count_if(F.col("label") == 1).alias("pos"), count_if(F.col("label") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("feature").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    wide = "decimal(38,0)"
    auc = per.withColumn("_below", below).groupBy("feature").agg(
        F.sum(F.col("pos").cast(wide) * (2 * F.col("_below").cast(wide) + F.col("neg"))).alias("_num"),
        F.sum("pos").cast(wide).alias("_p"), F.sum("neg").cast(wide).alias("_n")).select(
        "feature", half_up_ratio("_num", "2 * _p * _n", 6).alias("auc"))
    # one row per column of the model
    base = F.max(F.when(F.col("feature").isNull(), F.col("auc"))).over(Window.partitionBy())
    return auc.withColumn("base_auc", base).where("feature is not null").select(
        "feature", "base_auc", F.col("auc").alias("permuted_auc"),
        F.round(F.col("base_auc") - F.col("auc"), 6).alias("importance"))


def model_scorer(model: PipelineModel, cols: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds the model's probability of class 1 (4 places) as ``score``."""
    va = VectorAssembler(inputCols=cols, outputCol="features")

    def scored(rows: DataFrame) -> DataFrame:
        return model.transform(va.transform(rows)).withColumn("score", F.round(vector_to_array("probability")[1], 4))
    return scored


def evaluate(model: PipelineModel, test: DataFrame, id_col: str) -> DataFrame:
    """(metric, value): ROC-AUC (Spark evaluator), exact rank-sum AUC,
    precision, recall, F1 at 0.5.  The predictions are written once for all of them."""
    out = _written(model.transform(test).select("label", "probability"), scratch_path(test.sparkSession, "predictions"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label",
                                       metricName="areaUnderROC")
    auc_spark = ev.evaluate(out)
    # exact AUC on the unrounded probabilities (as the training report computes it)
    raw = out.select("label", vector_to_array("probability")[1].alias("score"))
    exact = auc_rank_sum(raw, places=None)
    m = binary_metrics(raw)  # the cut at 0.5 is made on the unrounded probability
    spark = test.sparkSession
    rows = [spark.range(1).select(F.lit("roc_auc").alias("metric"), F.lit(auc_spark).alias("value")),
            exact.select(F.lit("roc_auc_exact").alias("metric"), F.col("roc_auc").alias("value"))]
    for c in ("precision", "recall", "f1"):
        rows.append(m.select(F.lit(c).alias("metric"), F.col(c).alias("value")))
    out_df = rows[0]
    for r in rows[1:]:
        out_df = out_df.unionByName(r)
    return out_df


def run_record(name: str, model: PipelineModel, train: DataFrame, test: DataFrame, metrics: DataFrame,
               importances: DataFrame | None = None) -> DataFrame:
    """Identity, settings, row counts, metrics and (optionally) feature importances of a
    run as (run, key, value) rows, with the quality gate (ROC-AUC at least 0.70) as
    ``passed_gate``.  The settings are read from the fitted model; ``run_id`` and
    ``recorded_at`` tell appended runs apart."""
    spark = train.sparkSession
    fitted = model.stages[-1]
    now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    params = spark.createDataFrame([("run_id", uuid.uuid4().hex), ("recorded_at", now)]
                                   + [(k, str(fitted.getOrDefault(k))) for k in GBT_PARAMS], "key string, value string")
    counts = train.agg(F.count(F.lit(1)).alias("n")).select(F.lit("train_rows").alias("key"),
                                                           F.col("n").cast("string").alias("value")) \
        .unionByName(test.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("test_rows").alias("key"), F.col("n").cast("string").alias("value")))
    mets = metrics.select(F.col("metric").alias("key"), F.col("value").cast("string").alias("value"))
    gate = metrics.where(F.col("metric") == "roc_auc").select(
        F.lit("passed_gate").alias("key"), (F.col("value") >= MIN_ROC_AUC).cast("string").alias("value"))
    rows = params.unionByName(counts).unionByName(mets).unionByName(gate)
    if importances is not None:
        rows = rows.unionByName(importances.select(
            F.concat(F.lit("importance."), "feature").alias("key"),
            F.col("importance").cast("string").alias("value")))
    return rows.select(F.lit(name).alias("run"), "key", "value")


# ---------------------------------------------------------------------------
# Versioned model store on the shared folder
# ---------------------------------------------------------------------------

def save_model(model: PipelineModel, spark: SparkSession, base: str) -> str:
    """Register a new version ``base/v=N`` and return its path.  Two savers get two versions;
    a version counts once its completion marker is there."""
    return publish(spark, base, model.save)


def load_latest(spark: SparkSession, base: str) -> PipelineModel:
    """The newest version that was written to its end."""
    vs = list_versions(spark, base)
    if not vs:
        raise FileNotFoundError(f"no model registered under {base}")
    return PipelineModel.load(os.path.join(base, f"v={vs[-1]}"))


# ---------------------------------------------------------------------------
# End-to-end training and scoring
# ---------------------------------------------------------------------------

def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train_model(features: DataFrame, feature_cols: list[str], label: str, id_col: str,
                params: dict | None = None):
    """Returns (model, train, test, metrics).  The feature rows and then the split are written to
    the shared folder: split, weights, boosting and metrics read those instead of the features' plan."""
    spark = features.sparkSession
    fm = _written(feature_matrix(features, feature_cols, label, id_col), scratch_path(spark, "matrix"))
    fm = _written(stratified_split(fm, id_col, label="label"), scratch_path(spark, "split"))
    train = with_class_weight(fm.where(~F.col("is_test")))
    test = fm.where(F.col("is_test"))
    model = train_gbt(merged_rows(train, id_col), params)
    return model, train, test, evaluate(model, test, id_col)


def score(model: PipelineModel, features: DataFrame, feature_cols: list[str], id_col: str,
          score_col: str, rank_col: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) for all rows, or the listed ids (error when none match).
    The scores are written before they are ranked: the ranking reads them twice."""
    if ids is not None:
        keys = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
        features = features.join(keys, features[id_col] == keys._id, "left_semi")
        if features.limit(1).count() == 0:
            raise ValueError(f"No matching rows found for provided {id_col}s.")
    va = VectorAssembler(inputCols=feature_cols, outputCol="features")
    pred = predict(model, va.transform(features.select(id_col, *feature_cols)), id_col)
    pred = _written(pred.withColumnRenamed("score", score_col), scratch_path(features.sparkSession, "scored"))
    return global_row_number(pred, [F.col(score_col).desc(), F.col(id_col).asc()], rank_col)
