"""The batch lifecycle end to end at sf0.001: load, validate, features, train,
score, daily insights, document ingest and question answering."""

import datetime as dt

from pyspark.sql import functions as F

from dealgrid.plans import jobs

SF = "/root/testdata/sf0.001"


def test_lifecycle(spark, tmp_path):
    base = str(tmp_path)
    crm_dir, feat_dir, model_dir, out_dir = (f"{base}/crm", f"{base}/features", f"{base}/models",
                                             f"{base}/scores")
    counts = {r["table_name"]: r["rows"] for r in jobs.load_all(spark, SF, crm_dir).collect()}
    assert counts == {"reps": 10, "leads": 1500, "deals": 797, "engagement": 3255, "customers": 246}
    # loading twice replaces, never duplicates
    jobs.load_all(spark, SF, crm_dir).collect()
    assert spark.read.parquet(f"{crm_dir}/leads").count() == 1500

    issues = jobs.validate(spark, crm_dir, dt.date(2000, 1, 1)).collect()
    assert all(r["bad_rows"] > 0 for r in issues)

    n = jobs.build_features(spark, crm_dir, feat_dir)
    assert n == {"lead_features": 1500, "deal_features": 797 - spark.read.parquet(f"{crm_dir}/deals")
                 .where("outcome = 'open'").count()}

    runs = jobs.train_models(spark, feat_dir, model_dir, f"{base}/runs", params={"maxIter": 10})
    keys = {(r["run"], r["key"]) for r in runs.collect()}
    assert ("lead_scoring", "roc_auc") in keys and ("deal_risk", "passed_gate") in keys

    some = spark.read.parquet(f"{crm_dir}/leads").select("lead_id").limit(10)
    jobs.score(spark, feat_dir, model_dir, out_dir, lead_ids=some)
    ls = spark.read.parquet(f"{out_dir}/lead_scores")
    assert ls.count() == 10
    assert sorted(r["rank"] for r in ls.collect()) == list(range(1, 11))
    ds = spark.read.parquet(f"{out_dir}/deal_scores")
    assert ds.agg(F.min("risk_score") >= 0, F.max("risk_score") <= 1).first() == (True, True)

    when = dt.datetime(2026, 1, 2, 6, 0)
    new = jobs.daily_insights(spark, crm_dir, out_dir, f"{base}/insights", when).collect()
    assert 1 <= len(new) <= 3
    assert sorted(r["id"] for r in new) == [20260102 * 1000 + i for i in range(1, len(new) + 1)]
    again = jobs.daily_insights(spark, crm_dir, out_dir, f"{base}/insights", when + dt.timedelta(days=1))
    assert min(r["id"] for r in again.collect()) > max(r["id"] for r in new)
    # re-running a day replaces it: same rows, same ids, no duplicates
    day2 = sorted(r["id"] for r in again.collect())
    rerun = jobs.daily_insights(spark, crm_dir, out_dir, f"{base}/insights", when + dt.timedelta(days=1))
    assert sorted(r["id"] for r in rerun.collect()) == day2
    jobs.daily_insights(spark, crm_dir, out_dir, f"{base}/insights", when)
    # a day filled in late gets ids of its own
    late = jobs.daily_insights(spark, crm_dir, out_dir, f"{base}/insights", when - dt.timedelta(days=1)).collect()
    ids = [r["id"] for r in spark.read.parquet(f"{base}/insights").collect()]
    assert len(ids) == len(set(ids)) == len(new) + len(day2) + len(late)


def test_ingest_and_answer(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", F.col("source").alias("source_file"), "text")
    _, n = jobs.ingest_documents(spark, docs, str(tmp_path / "collection"))
    assert n > 0
    qs = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("question_id"), "text")
    out = jobs.answer_batch(spark, str(tmp_path / "collection"), qs)
    rows = out.collect()
    assert len(rows) == qs.count()
    assert all(r["prompt"].startswith("Context:\n[Source: ") and 1 <= len(r["sources"]) <= 5 for r in rows)
