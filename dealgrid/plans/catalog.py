"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (through the CRM views derived from them)
in full; nothing is sampled, capped or filtered to ids.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.ml.functions import vector_to_array

from dealgrid.operators import features as fe
from dealgrid.operators import insights as ins
from dealgrid.operators import ivf
from dealgrid.operators import postings as po
from dealgrid.operators import metrics as me
from dealgrid.operators import ml
from dealgrid.operators import presentation as pr
from dealgrid.operators import quality as dq
from dealgrid.operators import ranking as rk
from dealgrid.operators import retrieval as rv
from dealgrid.schemas import DEAL_FEATURE_COLS, LEAD_FEATURE_COLS
from dealgrid.session import scratch_path
from dealgrid.sources import files as io
from dealgrid.sources.crm import CRM, build_crm

# Reference date for the "created in the future" check (a parameter of the
# check; fixed here so the registered query is reproducible).
DQ_AS_OF = dt.date(2000, 1, 1)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


_VIEWS: dict[tuple, CRM] = {}


def crm_for(spark: SparkSession, sf_dir: str) -> CRM:
    """The CRM views of a data folder, defined once per session and reused (the
    DataFrames are plans; reuse saves re-analysis, not data)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _VIEWS:
        _VIEWS[key] = build_crm(spark, sf_dir)
    return _VIEWS[key]


def query(name: str):
    def deco(fn: Callable[[CRM], DataFrame]) -> Callable[[CRM], DataFrame]:
        REGISTRY[name] = lambda spark, sf_dir: fn(crm_for(spark, sf_dir))
        return fn
    return deco


def _dirty(c: CRM) -> dict[str, DataFrame]:
    """CRM tables with the raw (ship-date) event timestamps, for the window checks."""
    t = c.as_dict()
    t["engagement"] = c.engagement_raw
    return t


# -- 2.A scans ----------------------------------------------------------------
@query("scan_reps")
def _q(c): return c.reps


@query("scan_leads")
def _q(c): return c.leads


@query("scan_deals")
def _q(c): return c.deals


@query("scan_engagement")
def _q(c): return c.engagement


@query("scan_customers")
def _q(c): return c.customers


# -- 2.B data quality ------------------------------------------------------------
@query("dq_check_counts")
def _q(c): return dq.check_counts(_dirty(c), DQ_AS_OF)


@query("dq_report")
def _q(c): return dq.validate_all(_dirty(c), DQ_AS_OF)


@query("dq_report_totals")
def _q(c): return dq.dq_report_totals(dq.validate_all(_dirty(c), DQ_AS_OF))


@query("dq_leads")
def _q(c): return dq.validate_leads(c.leads, DQ_AS_OF)


@query("dq_deals")
def _q(c): return dq.validate_deals(c.deals, c.leads)


@query("dq_engagement")
def _q(c): return dq.validate_engagement(c.engagement_raw, c.deals)


@query("dq_customers")
def _q(c): return dq.validate_customers(c.customers)


@query("dq_quarantine_engagement")
def _q(c): return dq.quarantine(_dirty(c), DQ_AS_OF)["engagement"]


@query("dq_quarantine_leads")
def _q(c): return dq.quarantine(_dirty(c), DQ_AS_OF)["leads"]


@query("dq_required_fields")
def _q(c): return dq.required_fields(c.as_dict())


@query("dq_unique_keys")
def _q(c): return dq.unique_keys(c.as_dict())


@query("dq_foreign_keys")
def _q(c): return dq.foreign_keys(c.as_dict())


@query("feature_null_check")
def _q(c):
    lf = dq.feature_checks(fe.lead_features(c.leads), "lead_features", LEAD_FEATURE_COLS, "converted")
    df = dq.feature_checks(fe.deal_features(c.deals, c.engagement), "deal_features",
                           DEAL_FEATURE_COLS, "is_at_risk")
    return lf.unionByName(df)


# -- 2.C filters -----------------------------------------------------------------
@query("open_deals")
def _q(c): return c.deals.where(F.col("outcome") == "open")


@query("closed_deals")
def _q(c): return c.deals.where(F.col("outcome") != "open")


# -- 2.D joins / 2.E features and aggregations -----------------------------------
@query("active_deals")
def _q(c): return fe.active_deals(c.deals, c.reps, c.engagement)


@query("lead_features")
def _q(c): return fe.lead_features(c.leads)


@query("deal_features")
def _q(c): return fe.deal_features(c.deals, c.engagement)


@query("open_deal_features")
def _q(c): return fe.open_deal_features(c.deals, c.engagement)


@query("mrr_timeseries")
def _q(c): return me.mrr_timeseries(c.customers).select("month", "mrr")


@query("month_series")
def _q(c): return me.month_grid(c.customers)


@query("mrr_change")
def _q(c): return me.mrr_change(me.mrr_timeseries(c.customers))


@query("churn_by_tier")
def _q(c): return me.churn_by_tier(c.customers)


@query("pipeline_summary")
def _q(c): return me.pipeline_summary(c.deals)


@query("deal_velocity")
def _q(c): return me.deal_velocity(c.deals)


@query("deal_velocity_sql")
def _q(c): return me.deal_velocity_sql(c.deals, dt.date(2001, 9, 15))


@query("channel_conversion_top")
def _q(c): return me.channel_conversion_top(c.leads)


@query("at_risk_count")
def _q(c):
    """Scored (closed) deals above the risk threshold."""
    from dealgrid.functions.core import count_if
    from dealgrid.schemas import AT_RISK_THRESHOLD
    return rk.deal_risk_scores(c.deals, c.reps).agg(
        count_if(F.col("risk_score") > AT_RISK_THRESHOLD).alias("at_risk_count"),
        F.count(F.lit(1)).alias("scored_deals"))


@query("open_pipeline_value")
def _q(c): return me.open_pipeline_value(c.deals)


def _lead_labels(c: CRM) -> DataFrame:
    return c.leads.select("lead_id", F.col("converted").cast("int").alias("converted"))


@query("class_balance_leads")
def _q(c): return me.class_balance(_lead_labels(c), "converted")


@query("class_balance_deals")
def _q(c):
    closed = c.deals.where(F.col("outcome") != "open")
    return me.class_balance(closed.select((F.col("outcome") == "closed_lost").cast("int").alias("is_at_risk")),
                            "is_at_risk")


@query("conversion_by_attr")
def _q(c): return me.conversion_by_attr(c.leads)


@query("win_rate_by_rep")
def _q(c): return me.win_rate_by_rep(c.deals)


@query("deal_summary")
def _q(c): return me.deal_summary(c.deals)


@query("event_mix")
def _q(c): return me.event_mix(c.engagement)


@query("meeting_rate_by_outcome")
def _q(c): return me.meeting_rate_by_outcome(c.engagement, c.deals)


@query("churn_profile")
def _q(c): return me.churn_profile(c.customers)


@query("dataset_summary")
def _q(c): return me.dataset_summary(c.as_dict())


# -- 2.M generator rules --------------------------------------------------------------
@query("customers_from_won")
def _q(c): return me.customers_from_won(c.deals, c.leads)


@query("channel_mix")
def _q(c): return me.channel_mix(c.engagement)


@query("stale_win_rate")
def _q(c): return me.stale_win_rate(c.deals)


@query("cold_window_reply")
def _q(c): return me.cold_window_reply(c.engagement, c.deals)


@query("monthly_conversion")
def _q(c): return me.monthly_conversion(c.leads)


@query("tenure_churn_curve")
def _q(c): return me.tenure_churn_curve(c.customers)


@query("deals_from_converted")
def _q(c): return me.deals_from_converted(c.leads)


@query("velocity_stats")
def _q(c): return me.velocity_stats(c.deals)


# -- 2.F ranking on rule scores -------------------------------------------------------
@query("rule_score_leads")
def _q(c): return c.leads.select("lead_id", rk.lead_rule_score().alias("score"))


@query("rank_leads")
def _q(c): return rk.score_leads(c.leads)


@query("rank_deals")
def _q(c): return rk.score_deals(c.deals, c.reps)


@query("top10_leads")
def _q(c):
    scored = c.leads.select("lead_id", rk.lead_rule_score().alias("score"))
    return rk.top_n(scored, "score", "lead_id", "rank")


@query("top10_deals")
def _q(c): return rk.top_n(rk.deal_risk_scores(c.deals, c.reps), "risk_score", "deal_id", "risk_rank")


# -- 2.C/2.D/2.E/2.I page data on rule scores --------------------------------------


def _lead_scores(c: CRM) -> DataFrame:
    return pr.lead_scores(c.leads, rk.score_leads(c.leads))


def _lead_scores_unranked(c: CRM) -> DataFrame:
    """Leads with their score, for aggregates that do not need the rank."""
    return c.leads.select("lead_id", "source", "company_size", "industry", "converted",
                          rk.lead_rule_score().alias("score"))


def _deal_risk(c: CRM) -> DataFrame:
    base = fe.open_deals_base(c.deals, c.engagement)  # one engagement aggregation for both
    active = fe.active_deals(c.deals, c.reps, c.engagement, base=base)
    feats = fe.open_deal_features(c.deals, c.engagement, base=base)
    return pr.deal_risk_table(active, rk.score_open_deals(feats, c.deals, c.reps))


@query("score_leads_listed")
def _q(c):
    won_lead_ids = c.deals.where(F.col("outcome") == "closed_won").select("lead_id")
    return rk.score_leads(c.leads, lead_ids=won_lead_ids)


@query("lead_scores")
def _q(c): return _lead_scores(c)


@query("lead_filters")
def _q(c): return pr.apply_filters(_lead_scores(c), source="referral", industry="All", size="51-200")


@query("filter_options")
def _q(c): return pr.filter_options(c.leads)


@query("lead_priority_table")
def _q(c): return pr.lead_priority_table(_lead_scores(c))


@query("lead_cards")
def _q(c): return pr.lead_cards(_lead_scores_unranked(c))


@query("lead_cards_filtered")
def _q(c): return pr.lead_cards(pr.apply_filters(_lead_scores_unranked(c), industry="biotech"))


@query("score_by_source")
def _q(c): return pr.score_by_source(_lead_scores_unranked(c))


@query("score_distribution_leads")
def _q(c): return pr.score_distribution(_lead_scores_unranked(c), "score")


@query("score_distribution_deals")
def _q(c): return pr.score_distribution(rk.deal_risk_scores(c.deals, c.reps), "risk_score")


@query("deal_risk_table")
def _q(c): return _deal_risk(c)


@query("risk_cards")
def _q(c): return pr.risk_cards(_deal_risk(c))


@query("risk_alerts")
def _q(c): return pr.risk_alerts(_deal_risk(c))


def _silence_risk(c: CRM) -> DataFrame:
    """The risk page on a score of silence alone: days since the last contact over 100,
    at most 1.  It crosses both thresholds and meets them exactly."""
    base = fe.open_deals_base(c.deals, c.engagement)
    feats = fe.open_deal_features(c.deals, c.engagement, base=base)
    scores = feats.select("deal_id", F.least(F.lit(1.0), F.col("days_since_last_contact") / F.lit(100.0)).alias("risk_score"))
    return pr.deal_risk_table(fe.active_deals(c.deals, c.reps, c.engagement, base=base), scores)


def _silence_snapshot(c: CRM) -> DataFrame:
    return ins.snapshot(c.leads.sparkSession, c.customers, c.deals, c.leads, _silence_risk(c), scope="open")


@query("deal_risk_table_silence")
def _q(c): return _silence_risk(c)


@query("risk_cards_silence")
def _q(c): return pr.risk_cards(_silence_risk(c))


@query("risk_alerts_silence")
def _q(c): return pr.risk_alerts(_silence_risk(c))


@query("at_risk_count_silence")
def _q(c):
    return _silence_risk(c).agg(F.count_if(F.col("risk_score") > 0.7).alias("at_risk_count"),
                                F.count(F.lit(1)).alias("scored_deals"))


@query("snapshot_at_risk_silence")
def _q(c): return ins.snapshot_leaves(_silence_snapshot(c)).where(F.col("leaf").startswith("deals_at_risk"))


@query("rule_insights_silence")
def _q(c): return ins.rule_insights(_silence_snapshot(c))


@query("deal_risk_display")
def _q(c): return pr.deal_risk_display(_deal_risk(c))


@query("latest_insights")
def _q(c):
    return c.insights.orderBy(F.col("generated_at").desc(), F.col("id").desc()).limit(3) \
        .select("id", "insight_type", "summary", "generated_at")


@query("insight_cards")
def _q(c):
    latest = c.insights.orderBy(F.col("generated_at").desc(), F.col("id").desc()).limit(3)
    return pr.insight_cards(latest)


# -- 2.K retrieval ------------------------------------------------------------------


@query("scan_documents")
def _q(c): return rv.documents_view(c.extra["tables"].documents)


@query("chunk_documents")
def _q(c): return rv.chunk_documents(rv.documents_view(c.extra["tables"].documents),
                                     source_col="source_file")


@query("chunk_stats")
def _q(c): return rv.chunk_stats(rv.documents_view(c.extra["tables"].documents),
                                 source_col="source_file")


@query("topk_cosine")
def _q(c): return rv.nearest_vectors(*rv.vector_split(c.extra["tables"].embeddings))


def _postings(c: CRM):
    chunks = rv.chunk_documents(rv.documents_view(c.extra["tables"].documents), source_col="source_file")
    return po.build_postings(chunks)


@query("embed_chunks_sparse")
def _q(c):
    return _postings(c)[0]


@query("text_topk_sparse")
def _q(c):
    questions = c.extra["tables"].benchmark.select(F.col("item_id").alias("question_id"), "text")
    return po.topk(questions, *_postings(c))


def _ivf(c: CRM):
    """Questions: every vector whose id is divisible by 20, against all vectors."""
    questions, corpus = rv.vector_split(c.extra["tables"].embeddings)
    questions = questions.where(F.col("question_id") % 20 == 0)
    return (*ivf.index_and_search(c.leads.sparkSession, corpus, questions, exclude_self=True), questions, corpus)


@query("topk_cosine_ivf")
def _q(c):
    return _ivf(c)[1].withColumn("similarity", F.round("similarity", 6))


@query("topk_cosine_ivf_recall")
def _q(c):
    index, hits, questions, corpus = _ivf(c)
    measured = ivf.recall(hits, rv.topk_cosine(questions, corpus, exclude_self=True))
    return measured.select(index.agg(F.count("*")).scalar().alias("indexed_rows"), "questions", F.col("wanted").cast("long").alias("wanted"),
                           (F.col("recall") >= 0.9).alias("recall_reached"))


@query("retrieval_sources")
def _q(c): return rv.retrieval_sources(rv.nearest_vectors(*rv.vector_split(c.extra["tables"].embeddings)))


@query("text_topk")
def _q(c):
    hits, _ = rv.text_hits(c.extra["tables"].documents, c.extra["tables"].benchmark, carry=("source_file",))
    return hits.select("question_id", "rank", "chunk_id", "source_file",
                       F.round("similarity", 6).alias("similarity"))


@query("embed_chunks")
def _q(c):
    _, corpus = rv.embedded_corpus(c.extra["tables"].documents)
    return corpus.select("chunk_id", "source_file", "chunk_index", "embedding")


@query("vector_collection_rebuild")
def _q(c):
    spark = c.leads.sparkSession
    _, corpus = rv.embedded_corpus(c.extra["tables"].documents)
    coll = corpus.select(
        F.col("chunk_id").alias("id"), "embedding", "document",
        F.struct("source_file", "chunk_index").alias("metadata"))
    path = scratch_path(spark, "collection")
    io.write_parquet(coll, path)
    return spark.read.parquet(path).select("id", "metadata.source_file", "metadata.chunk_index",
                                           F.size("embedding").alias("dim"))


@query("context_assembly")
def _q(c):
    hits, qtext = rv.text_hits(c.extra["tables"].documents, c.extra["tables"].benchmark)
    return rv.context_assembly(hits, qtext)


def _vector_requests(c: CRM) -> tuple[DataFrame, DataFrame]:
    """Hits and questions over the vector corpus; a vector's text is its id."""
    e = c.extra["tables"].embeddings
    hits = rv.nearest_vectors(*rv.vector_split(e)) \
        .withColumn("document", F.concat(F.lit("vector "), F.col("chunk_id").cast("string")))
    return hits, e.select(F.col("vec_id").alias("question_id"),
                          F.concat(F.lit("neighbours of "), F.col("vec_id").cast("string")).alias("text"))


@query("context_assembly_vectors")
def _q(c):
    hits, asked = _vector_requests(c)
    return rv.context_assembly(hits, asked.where(F.col("question_id").isNotNull()))


@query("context_supported_vectors")
def _q(c):
    """Only neighbours of similarity 0.35 or more are evidence; the other questions get an empty context."""
    hits, asked = _vector_requests(c)
    return rv.context_assembly(rv.supported(hits, 0.35), asked)


# -- 2.L snapshot and insights ---------------------------------------------------------


def _snapshot(c: CRM, scope: str = "closed") -> DataFrame:
    spark = c.leads.sparkSession
    scores = rk.deal_risk_scores(c.deals, c.reps) if scope == "closed" else _deal_risk(c)
    return ins.snapshot(spark, c.customers, c.deals, c.leads, scores, scope=scope)


@query("snapshot_json")
def _q(c): return ins.snapshot_json(_snapshot(c))


@query("snapshot_json_leaves")
def _q(c):
    """The leaves of the snapshot's JSON text, decoded again."""
    snap = _snapshot(c)
    kind = snap.drop("at_risk_scope").schema
    decoded = ins.snapshot_json(snap).select(F.from_json("data_snapshot", kind).alias("s")).select("s.*")
    return ins.snapshot_leaves(decoded)


@query("metrics_snapshot")
def _q(c): return ins.snapshot_leaves(_snapshot(c))


@query("snapshot_at_risk_open")
def _q(c): return ins.snapshot_leaves(_snapshot(c, "open")).where(F.col("leaf").startswith("deals_at_risk"))


@query("rule_insights")
def _q(c): return ins.rule_insights(_snapshot(c))


@query("parse_insights")
def _q(c): return ins.parse_insights(ins.render_responses(ins.rule_insights(_snapshot(c))))[0]


@query("parse_insights_rejects")
def _q(c): return ins.parse_insights(ins.render_responses(ins.rule_insights(_snapshot(c))))[1]


def _response_log(c: CRM) -> DataFrame:
    """A log of texts to parse, from the given tables: the insights of every ten minutes as a fenced
    JSON reply, and every assistant turn of the conversations (none of them JSON)."""
    item = F.struct("id", "insight_type", "summary")
    by_window = c.insights.groupBy(F.window(F.col("generated_at").cast("timestamp"), "10 minutes")["start"].alias("at")).agg(
        F.array_sort(F.collect_list(item)).alias("i"))
    told = F.to_json(F.transform("i", lambda x: F.struct(x["insight_type"].alias("insight_type"), x["summary"].alias("summary"))))
    replies = by_window.select(F.date_format("at", "yyyy-MM-dd HH:mm").alias("response_id"), F.col("at").alias("generated_at"),
                               F.concat(F.lit("```json\n"), told, F.lit("\n```")).alias("text"), told.alias("data_snapshot"))
    turns = c.extra["tables"].conversations.where("role = 'assistant'")
    return replies.unionByName(turns.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"),
        F.lit(None).cast("timestamp").alias("generated_at"), "text", F.lit(None).cast("string").alias("data_snapshot")))


@query("response_log_insights")
def _q(c): return ins.parse_insights(_response_log(c))[0]


@query("response_log_rejects")
def _q(c): return ins.parse_insights(_response_log(c))[1]


@query("response_log_days")
def _q(c): return ins.response_rows(_response_log(c))[0]


def _appended(c: CRM) -> DataFrame:
    spark = c.leads.sparkSession
    path = scratch_path(spark, "insights")
    io.write_parquet(c.insights, path)
    table = spark.read.parquet(path)
    snap = _snapshot(c)
    as_of = table.agg(F.date_trunc("day", F.max("generated_at")) + F.expr("INTERVAL 1 DAY")).scalar()
    new = ins.append_insights(table, ins.rule_insights(snap), ins.snapshot_json(snap), as_of)
    io.write_parquet(new, path, mode="append")
    return spark.read.parquet(path)


@query("insights_append")
def _q(c): return _appended(c).select("id", "generated_at", "insight_type", "summary")


@query("latest_insights_after_append")
def _q(c):
    t = _appended(c)
    return t.orderBy(F.col("generated_at").desc(), F.col("id").desc()).limit(3) \
        .select("id", "insight_type", "summary", "generated_at")


# -- 2.A sources and sinks ---------------------------------------------------------
@query("csv_round_trip_leads")
def _q(c):
    spark = c.leads.sparkSession
    path = scratch_path(spark, "csv-leads")
    io.write_csv(c.leads, path)
    return io.read_table(spark, path, "leads")


@query("csv_round_trip_deals")
def _q(c):
    spark = c.leads.sparkSession
    path = scratch_path(spark, "csv-deals")
    io.write_csv(c.deals, path)
    return io.read_table(spark, path, "deals")


@query("csv_load_checked")
def _q(c):
    """Deals exported with their value as text, unreadable in every deal whose value
    divides by 97, and loaded with rejects: rows and value of both sides."""
    spark = c.leads.sparkSession
    path = scratch_path(spark, "csv-damaged")
    bad = F.when(F.col("value") % 97 == 0, F.concat(F.lit("n/a, "), F.col("value").cast("string")))
    io.write_csv(c.deals.withColumn("value", F.coalesce(bad, F.col("value").cast("string"))), path)
    rows, rejects = io.read_checked(spark, path, "deals")
    return rows.agg(F.lit("loaded").alias("part"), F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total")).unionByName(
        rejects.agg(F.lit("rejected").alias("part"), F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum(F.substring("row.value", 6, 20).cast("long")), F.lit(0)).alias("total")))


@query("csv_load_constraints")
def _q(c):
    """CRM tables exported with faults and loaded as their constraints admit: leads missing,
    leads twice, leads without an industry; their deals and events lose their parents."""
    from dealgrid.plans import jobs
    spark = c.leads.sparkSession
    store, number = scratch_path(spark, "csv-faults"), F.substring("lead_id", 5, 20).cast("long")
    leads = c.leads.where(number % 83 != 0)
    leads = leads.unionByName(leads.where(number % 89 == 0)).withColumn("industry", F.when(number % 79 != 0, F.col("industry")))
    for name, df in {**c.as_dict(), "leads": leads}.items():
        io.write_csv(df, f"{store}/csv/{name}")
    jobs.publish_csv(spark, f"{store}/csv", f"{store}/crm")
    return jobs.load_outcome(spark, f"{store}/crm")


@query("feature_table_replace")
def _q(c):
    spark = c.leads.sparkSession
    path = scratch_path(spark, "lead-features")
    io.write_parquet(fe.lead_features(c.leads), path)
    return spark.read.parquet(path)


@query("full_refresh_load")
def _q(c):
    spark = c.leads.sparkSession
    return io.full_refresh(spark, c.as_dict(), scratch_path(spark, "crm"))


@query("active_deals_bucketed")
def _q(c):
    """The flagship on a bucketed copy of the CRM tables (co-located deal joins)."""
    import uuid
    spark = c.leads.sparkSession
    t = io.write_bucketed(spark, c.as_dict(), scratch_path(spark, "crm-bucketed"),
                          n_buckets=int(spark.conf.get("spark.sql.shuffle.partitions")),
                          prefix=f"crm_{uuid.uuid4().hex[:8]}")
    return fe.active_deals(t["deals"], t["reps"], t["engagement"])


@query("load_reconciliation")
def _q(c):
    spark = c.leads.sparkSession
    out = scratch_path(spark, "crm")
    io.full_refresh(spark, c.as_dict(), out).collect()
    loaded = {n: spark.read.parquet(f"{out}/{n}") for n in io.LOAD_ORDER}
    return io.reconcile(c.as_dict(), loaded)


# -- 2.J machine learning --------------------------------------------------------------


_MODELS: dict[tuple, tuple] = {}


def _trained(c: CRM, which: str):
    """Train once per (application, data folder, model); reused by the ML queries."""
    spark = c.leads.sparkSession
    key = (spark.sparkContext.applicationId, c.extra["tables"].sf_dir, which)
    if key not in _MODELS:
        if which == "leads":
            feats, cols, label, idc = fe.lead_features(c.leads), LEAD_FEATURE_COLS, "converted", "lead_id"
        else:
            feats, cols, label, idc = (fe.deal_features(c.deals, c.engagement), DEAL_FEATURE_COLS,
                                       "is_at_risk", "deal_id")
        model, train, test, metrics = ml.train_model(feats, cols, label, idc)
        _MODELS[key] = (model, train, test, metrics.cache(), feats, cols, idc)
    return _MODELS[key]


def _rule_scored_leads(c: CRM) -> DataFrame:
    return c.leads.select(rk.lead_rule_score().alias("score"),
                          F.col("converted").cast("int").alias("label"))


def _rule_scored_deals(c: CRM) -> DataFrame:
    scores = rk.deal_risk_scores(c.deals, c.reps)
    labels = c.deals.select("deal_id", (F.col("outcome") == "closed_lost").cast("int").alias("label"))
    return scores.join(labels, "deal_id").select(F.col("risk_score").alias("score"), "label")


@query("auc_rule_leads")
def _q(c):
    s = _rule_scored_leads(c)
    return ml.auc_rank_sum(s).select(
        "roc_auc", ml.binary_metrics(s).select(F.struct("precision", "recall", "f1")).scalar().alias("m")
    ).select("roc_auc", "m.precision", "m.recall", "m.f1")


@query("auc_rule_deals")
def _q(c):
    s = _rule_scored_deals(c)
    return ml.auc_rank_sum(s).select(
        "roc_auc", ml.binary_metrics(s).select(F.struct("precision", "recall", "f1")).scalar().alias("m")
    ).select("roc_auc", "m.precision", "m.recall", "m.f1")


@query("classification_report_rule_leads")
def _q(c): return ml.classification_report(_rule_scored_leads(c), names=("not_converted", "converted"))


@query("classification_report_rule_deals")
def _q(c): return ml.classification_report(_rule_scored_deals(c), names=("won", "at_risk"))


@query("feature_matrix_leads")
def _q(c):
    fm = ml.feature_matrix(fe.lead_features(c.leads), LEAD_FEATURE_COLS, "converted", "lead_id")
    return fm.select("lead_id", vector_to_array("features").alias("features"), "label")


@query("feature_matrix_deals")
def _q(c):
    fm = ml.feature_matrix(fe.deal_features(c.deals, c.engagement), DEAL_FEATURE_COLS, "is_at_risk",
                           "deal_id")
    return fm.select("deal_id", vector_to_array("features").alias("features"), "label")


@query("stratified_split_leads")
def _q(c):
    fm = ml.stratified_split(_lead_labels(c), "lead_id", label="converted")
    return fm.groupBy("converted", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@query("split_rows_leads")
def _q(c): return ml.stratified_split(_lead_labels(c), "lead_id", label="converted")


@query("split_rows_deals")
def _q(c):
    closed = c.deals.where(F.col("outcome") != "open").select(
        "deal_id", (F.col("outcome") == "closed_lost").cast("int").alias("is_at_risk"))
    return ml.stratified_split(closed, "deal_id", label="is_at_risk")


RULE_COLS = ["source", "company_size", "industry", "lead_month"]


@query("permutation_importance_leads")
def _q(c):
    rows = c.leads.select("lead_id", F.col("converted").cast("int").alias("converted"), "source",
                          "company_size", "industry", F.month("created_at").alias("lead_month"))
    return ml.permutation_importance(
        rows, "lead_id", RULE_COLS, "converted",
        lambda d: d.withColumn("score", rk.lead_rule_score(month=F.col("lead_month"))))


def _held_out_importance(c: CRM, which: str) -> DataFrame:
    model, _, test, _, _, cols, idc = _trained(c, which)
    x = vector_to_array("features")
    rows = test.select(idc, "label", *[x[i].alias(col) for i, col in enumerate(cols)])
    return ml.permutation_importance(rows, idc, cols, "label", ml.model_scorer(model, cols))


@query("permutation_importance_leads_model")
def _q(c): return _held_out_importance(c, "leads")


@query("permutation_importance_deals_model")
def _q(c): return _held_out_importance(c, "deals")


@query("top10_leads_model")
def _q(c):
    model, _, _, _, feats, cols, idc = _trained(c, "leads")
    scored = ml.predict(model, ml.feature_matrix(feats, cols, "converted", idc), idc)
    return rk.top_n(scored, "score", idc, "rank")


@query("score_distribution_leads_model")
def _q(c):
    model, _, _, _, feats, cols, idc = _trained(c, "leads")
    return pr.score_distribution(ml.predict(model, ml.feature_matrix(feats, cols, "converted", idc),
                                            idc), "score")


@query("train_lead_model")
def _q(c):
    model, train, test, metrics, *_ = _trained(c, "leads")
    return ml.run_record("lead_scoring", model, train, test, metrics,
                         ml.feature_importances(model, LEAD_FEATURE_COLS))


@query("train_deal_model")
def _q(c):
    model, train, test, metrics, *_ = _trained(c, "deals")
    return ml.run_record("deal_risk", model, train, test, metrics,
                         ml.feature_importances(model, DEAL_FEATURE_COLS))


@query("feature_importances_leads")
def _q(c):
    model, *_ = _trained(c, "leads")
    return ml.feature_importances(model, LEAD_FEATURE_COLS)


@query("feature_importances_deals")
def _q(c):
    model, *_ = _trained(c, "deals")
    return ml.feature_importances(model, DEAL_FEATURE_COLS)


@query("score_leads_model")
def _q(c):
    model, _, _, _, feats, cols, idc = _trained(c, "leads")
    return ml.score(model, feats, cols, idc, "score", "rank")


@query("score_deals_model")
def _q(c):
    model, _, _, _, feats, cols, idc = _trained(c, "deals")
    return ml.score(model, feats, cols, idc, "risk_score", "risk_rank")


def _score_check(scored: DataFrame, id_col: str, score: str, rank: str) -> DataFrame:
    """What must hold for any model's written scores: one row per id, ranks 1..n, scores
    in [0, 1], and every rank's successor has a lower score or the same and a larger id."""
    spark = scored.sparkSession
    path = scratch_path(spark, "scores")
    io.write_parquet(scored.select(id_col, score, rank), path)
    s = spark.read.parquet(path)
    after = s.select((F.col(rank) - 1).alias(rank), F.col(score).alias("_score"), F.col(id_col).alias("_id"))
    wrong = (F.col("_score") > F.col(score)) | ((F.col("_score") == F.col(score)) & (F.col("_id") < F.col(id_col)))
    return s.join(after, rank, "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(id_col).alias("ids"),
        F.min(rank).alias("min_rank"), F.max(rank).alias("max_rank"),
        F.count_if(~F.col(score).between(0, 1)).alias("out_of_range"), F.count_if(wrong).alias("misordered"))


@query("score_check_leads")
def _q(c):
    model, _, _, _, feats, cols, idc = _trained(c, "leads")
    return _score_check(ml.score(model, feats, cols, idc, "score", "rank"), idc, "score", "rank")


@query("score_check_deals")
def _q(c):
    model, _, _, _, feats, cols, idc = _trained(c, "deals")
    return _score_check(ml.score(model, feats, cols, idc, "risk_score", "risk_rank"), idc, "risk_score", "risk_rank")


@query("score_check_open_deals")
def _q(c):
    model, _, _, _, _, cols, idc = _trained(c, "deals")
    feats = fe.open_deal_features(c.deals, c.engagement)
    return _score_check(ml.score(model, feats, cols, idc, "risk_score", "risk_rank"), idc, "risk_score", "risk_rank")


@query("score_open_deals_model")
def _q(c):
    model, _, _, _, _, cols, idc = _trained(c, "deals")
    base = fe.open_deals_base(c.deals, c.engagement)
    scores = ml.score(model, fe.open_deal_features(c.deals, c.engagement, base=base), cols, idc,
                      "risk_score", "risk_rank")
    return pr.deal_risk_table(fe.active_deals(c.deals, c.reps, c.engagement, base=base), scores)


@query("model_save_load")
def _q(c):
    spark = c.leads.sparkSession
    model, _, _, _, feats, cols, idc = _trained(c, "leads")
    base = scratch_path(spark, "models/lead_scoring")
    ml.save_model(model, spark, base)
    ml.save_model(model, spark, base)
    latest = ml.load_latest(spark, base)
    return ml.score(latest, feats, cols, idc, "score", "rank").withColumn(
        "version", F.lit(ml.list_versions(spark, base)[-1]))
