"""End-to-end batch jobs: the application's entry points as Spark jobs.

Each job reads tables from a folder, runs operators, and writes tables to a
folder (all paths on shared storage).  They replace the command-line steps
load -> transform -> train -> predict, the daily insight run, document ingest
and question answering.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.operators import features as fe
from dealgrid.operators import insights as ins
from dealgrid.operators import ml
from dealgrid.operators import quality as dq
from dealgrid.operators import retrieval as rv
from dealgrid.schemas import DEAL_FEATURE_COLS, LEAD_FEATURE_COLS, TABLE_SCHEMAS
from dealgrid.session import scratch_path
from dealgrid.sources import files as io
from dealgrid.sources.constraints import judged
from dealgrid.sources.crm import build_crm
from dealgrid.sources.versions import current, exists, publish

TABLES = io.LOAD_ORDER


def _p(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def read_crm(spark: SparkSession, crm_dir: str) -> dict[str, DataFrame]:
    """All tables of one load: of the newest complete version, if loads are published there."""
    at = current(spark, crm_dir)
    return {n: spark.read.parquet(_p(at, n)) for n in TABLES}


def load_all(spark: SparkSession, source_dir: str, crm_dir: str) -> DataFrame:
    """Derive the CRM tables from the given tables and write them (full refresh).
    Returns (table_name, rows)."""
    crm = build_crm(spark, source_dir)
    return io.full_refresh(spark, crm.as_dict(), crm_dir)


def publish_all(spark: SparkSession, source_dir: str, crm_dir: str) -> DataFrame:
    """``load_all`` into a new version below ``crm_dir``: readers change from the old tables to
    the new ones at once, and stay on the old ones if a table fails."""
    crm = build_crm(spark, source_dir).as_dict()
    at = publish(spark, crm_dir, lambda path: io.full_refresh(spark, crm, path))
    return io.reconcile(crm, {n: spark.read.parquet(_p(at, n)) for n in TABLES})


def publish_csv(spark: SparkSession, csv_dir: str, crm_dir: str) -> DataFrame:
    """CSV files to a new version of the CRM tables, holding what the tables' constraints
    admit (see ``constraints.judged``); everything else goes to its ``rejected_<table>``
    (at, row, reasons).  Returns (table_name, source_rows, loaded_rows, ok)."""
    staged = {}

    def write(path: str) -> None:
        for name in TABLES:
            store = scratch_path(spark, f"load-{name}")
            io.write_parquet(io.read_placed(spark, _csv_path(spark, csv_dir, name), name), _p(store, "placed"))
            placed = staged[name] = spark.read.parquet(_p(store, "placed"))
            fits = placed.where(F.size("reasons") == 0).select("at", "row", "parsed.*")
            rows = judged(fits, name, lambda parent: spark.read.parquet(_p(path, parent)))
            io.write_parquet(rows, _p(store, "judged"))
            rows = spark.read.parquet(_p(store, "judged"))
            columns = [f.name for f in TABLE_SCHEMAS[name].fields]
            io.write_parquet(rows.where(F.size("reasons") == 0).select(*columns), _p(path, name))
            rejects = placed.where(F.size("reasons") > 0).select("at", "row", "reasons")
            io.write_parquet(rejects.unionByName(rows.where(F.size("reasons") > 0).select("at", "row", "reasons")),
                             _p(path, f"rejected_{name}"))
    at = publish(spark, crm_dir, write)
    return io.reconcile(staged, {n: spark.read.parquet(_p(at, n)) for n in TABLES})


def load_outcome(spark: SparkSession, crm_dir: str) -> DataFrame:
    """(table_name, outcome, rows) of the newest published CSV load: 'loaded', and each reason
    with the number of rows rejected for it."""
    at, parts = current(spark, crm_dir), None
    for name in TABLES:
        rejects = spark.read.parquet(_p(at, f"rejected_{name}")).select(F.explode("reasons").alias("outcome"))
        part = (rejects.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))
                .unionByName(spark.read.parquet(_p(at, name)).agg(F.lit("loaded").alias("outcome"), F.count(F.lit(1)).alias("rows")))
                .select(F.lit(name).alias("table_name"), "outcome", "rows"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _csv_path(spark: SparkSession, csv_dir: str, name: str) -> str:
    path = _p(csv_dir, name)
    return path if exists(spark, path) else path + ".csv"


def load_csv(spark: SparkSession, csv_dir: str, crm_dir: str) -> DataFrame:
    """CSV files (one folder or file ``<table>`` or ``<table>.csv`` each) to CRM tables.
    Rows that do not fit the schema go to ``rejected_<table>`` below ``crm_dir``.
    Returns (table_name, source_rows, loaded_rows, ok); rejects make ok false."""
    loaded, source = {}, {}
    for name in TABLES:
        rows, rejects = io.read_checked(spark, _csv_path(spark, csv_dir, name), name)
        io.write_parquet(rows, _p(crm_dir, name))
        io.write_parquet(rejects, _p(crm_dir, f"rejected_{name}"))
        loaded[name] = spark.read.parquet(_p(crm_dir, name))
        source[name] = loaded[name].select(F.lit(1).alias("one")).unionByName(
            spark.read.parquet(_p(crm_dir, f"rejected_{name}")).select(F.lit(1).alias("one")))
    return io.reconcile(source, loaded)


def validate(spark: SparkSession, crm_dir: str, as_of: dt.date) -> DataFrame:
    """All data-quality issues of the loaded tables (one message per issue)."""
    return dq.validate_all(read_crm(spark, crm_dir), as_of)


def build_features(spark: SparkSession, crm_dir: str, features_dir: str) -> dict[str, int]:
    """Write lead_features and deal_features (replacing them) plus the category
    mapping used for the lead codes, so scoring reuses the same codes."""
    t = read_crm(spark, crm_dir)
    mappings = fe.category_mappings(t["leads"])
    for col, m in mappings.items():
        io.write_parquet(m, _p(features_dir, f"mapping_{col}"))
    saved = {c: spark.read.parquet(_p(features_dir, f"mapping_{c}")) for c in mappings}
    io.write_parquet(fe.lead_features(t["leads"], saved), _p(features_dir, "lead_features"))
    io.write_parquet(fe.deal_features(t["deals"], t["engagement"]), _p(features_dir, "deal_features"))
    return {n: spark.read.parquet(_p(features_dir, n)).count() for n in ("lead_features", "deal_features")}


def train_models(spark: SparkSession, features_dir: str, model_dir: str, runs_path: str,
                 params: dict | None = None) -> DataFrame:
    """Train both models, register a new version of each, append the run
    records (params, metrics, gate) to ``runs_path``."""
    specs = [("lead_scoring", "lead_features", LEAD_FEATURE_COLS, "converted", "lead_id"),
             ("deal_risk", "deal_features", DEAL_FEATURE_COLS, "is_at_risk", "deal_id")]
    for name, table, cols, label, idc in specs:
        feats = spark.read.parquet(_p(features_dir, table))
        bad = [f"{r['check_name']}: {r['bad_rows']}" for r in
               dq.feature_checks(feats, table, cols, label).where("bad_rows > 0").collect()]  # one row a check
        if bad:
            raise ValueError(f"{table} fails its checks: {', '.join(bad)}")
        model, train, test, metrics = ml.train_model(feats, cols, label, idc, params)
        ml.save_model(model, spark, _p(model_dir, name))
        imp = ml.feature_importances(model, cols)
        io.write_parquet(ml.run_record(name, model, train, test, metrics, imp), runs_path, mode="append")
    return spark.read.parquet(runs_path)


def score(spark: SparkSession, features_dir: str, model_dir: str, out_dir: str,
          lead_ids: DataFrame | None = None, deal_ids: DataFrame | None = None) -> None:
    """Score all (or the listed) leads and closed deals with the newest models."""
    lf = spark.read.parquet(_p(features_dir, "lead_features"))
    df = spark.read.parquet(_p(features_dir, "deal_features"))
    lm = ml.load_latest(spark, _p(model_dir, "lead_scoring"))
    dm = ml.load_latest(spark, _p(model_dir, "deal_risk"))
    io.write_parquet(ml.score(lm, lf, LEAD_FEATURE_COLS, "lead_id", "score", "rank", lead_ids),
                     _p(out_dir, "lead_scores"))
    io.write_parquet(ml.score(dm, df, DEAL_FEATURE_COLS, "deal_id", "risk_score", "risk_rank", deal_ids),
                     _p(out_dir, "deal_scores"))


def daily_insights(spark: SparkSession, crm_dir: str, scores_dir: str, insights_path: str,
                   generated_at: dt.datetime) -> DataFrame:
    """Snapshot -> typed insights -> the insights table (with the snapshot JSON).

    The table is partitioned by ``run_date``; a run overwrites only its own
    day (dynamic partition overwrite), so re-running a day after a failure or
    a retry replaces that day's rows instead of adding a second copy.  An id is
    the day (yyyymmdd) followed by the insight's position, so ids are unique
    in whatever order days are run, filled in late or repeated.  Returns the
    day's rows.
    """
    t = read_crm(spark, crm_dir)
    scores = spark.read.parquet(_p(scores_dir, "deal_scores"))
    snap = ins.snapshot(spark, t["customers"], t["deals"], t["leads"], scores)
    new_insights = ins.rule_insights(snap)
    run_date = generated_at.date()
    start = int(run_date.strftime("%Y%m%d")) * 1000
    rows = ins.append_insights(spark.range(1).select(F.lit(start).cast("long").alias("id")),
                               new_insights, ins.snapshot_json(snap), F.lit(generated_at))
    rows = rows.withColumn("run_date", F.lit(run_date))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(insights_path))
    return spark.read.parquet(insights_path).where(F.col("run_date") == F.lit(run_date))


def response_insights(spark: SparkSession, responses: DataFrame, insights_path: str,
                      rejects_path: str) -> tuple[DataFrame, DataFrame]:
    """A log of response texts (response_id, generated_at, text, data_snapshot) -> the insights
    table that ``daily_insights`` writes, all three insights of a day or none, and the rejects
    with their reasons.  Both are replaced day by day (dynamic partition overwrite): a repeated run
    changes nothing, and days without an accepted response keep the rows they had.  The log is written
    once before it is judged.  Returns (insight rows, rejects) of the run."""
    path = scratch_path(spark, "responses")
    io.write_parquet(responses.select("response_id", "generated_at", "text", "data_snapshot"), path)
    rows, rejects = ins.response_rows(spark.read.parquet(path))
    for part, out in ((rows, insights_path), (rejects, rejects_path)):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(out)
    return rows, rejects


def ingest_documents(spark: SparkSession, docs: DataFrame, collection_path: str, dim: int = 512):
    """Chunk documents (doc_id, source_file, text), fit the embedder, rebuild the
    vector collection: chunks are cut once, and vectors and embedder change together, as one
    published version.  Returns (model, number of chunks)."""
    made = {}

    def write(path: str) -> None:
        io.write_parquet(rv.chunk_documents(docs, source_col="source_file"), scratch := scratch_path(spark, "chunks"))
        chunks = spark.read.parquet(scratch)
        made["model"] = model = rv.fit_embedder(chunks, dim=dim)
        io.write_parquet(rv.embed(model, chunks).select("chunk_id", "source_file", "chunk_index", "document",
                                                        "embedding"), _p(path, "chunks"))
        model.write().save(_p(path, "embedder"))
    at = publish(spark, collection_path, write)
    return made["model"], spark.read.parquet(_p(at, "chunks")).count()


def answer_batch(spark: SparkSession, collection_path: str, questions: DataFrame,
                 k: int = 5, min_similarity: float | None = None) -> DataFrame:
    """(question_id, sources, prompt) for a batch of questions (question_id, text):
    k nearest chunks by cosine, sources, and the grounded request text.  With
    ``min_similarity`` only hits at least that near count: a question that the documents do not
    cover gets no sources and an empty context."""
    from pyspark.ml import PipelineModel
    at = current(spark, collection_path)
    model = PipelineModel.load(_p(at, "embedder"))
    coll = spark.read.parquet(_p(at, "chunks"))
    q = rv.embed(model, questions.select("question_id", F.col("text").alias("document")))
    hits = rv.topk_cosine(q, coll, k, carry=["source_file", "document"])
    return rv.context_assembly(hits if min_similarity is None else rv.supported(hits, min_similarity), questions)
