"""Distributed global ranking equals an un-partitioned row_number, also with a
hot score value holding a third of the rows; rule scores at thresholds."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from dealgrid.operators import ranking as rk
from dealgrid.operators.presentation import priority_label


def test_global_row_number_with_hot_score(spark):
    n = 3000
    df = spark.range(n).select(
        F.format_string("ID%05d", (F.col("id") * 7919) % n).alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.round(F.rand(7), 2)).alias("score"))
    ours = rk.global_row_number(df, [F.col("score").desc(), F.col("key").asc()], "rank")
    ref = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))
    a = {r["key"]: r["rank"] for r in ours.collect()}
    b = {r["key"]: r["rank"] for r in ref.collect()}
    assert a == b
    assert sorted(a.values()) == list(range(1, n + 1))


def test_ranks_ignore_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"),
                                 (F.col("id") % 7).cast("double").alias("score"))
    a = rk.global_row_number(df.repartition(1), [F.col("score").desc(), F.col("key").asc()])
    b = rk.global_row_number(df.repartition(13), [F.col("score").desc(), F.col("key").asc()])
    assert sorted(a.collect()) == sorted(b.collect())


def test_dense_codes_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "v string")
    got = sorted((r["value"], r["code"]) for r in rk.dense_codes(df, "v", "code").collect())
    assert got == [("a", 0), ("b", 1), ("c", 2)]


def test_lead_rule_score_exact_and_capped(spark):
    df = spark.createDataFrame([
        ("referral", "51-200", "pharma", dt.date(2024, 10, 1)),   # 0.35*1.9*1.3*1.4 = 1.2103 -> cap
        ("paid_search", "1-10", "cro", dt.date(2024, 3, 1)),      # 0.08*0.4*0.7*0.5 = 0.0112
        ("organic", "11-50", "biotech", dt.date(2024, 6, 1)),     # 0.14*0.8*1.2 = 0.1344
        ("event", "201-1000", "research_university", dt.date(2024, 8, 1)),  # .35*1.2*.5*.5 = .105
    ], "source string, company_size string, industry string, created_at date")
    got = [r[0] for r in df.select(rk.lead_rule_score()).collect()]
    assert got == [0.95, 0.0112, 0.1344, 0.105]


def test_deal_rule_risk(spark):
    df = spark.createDataFrame([(20, False), (3, False), (20, True), (3, True)], "d int, o boolean")
    got = [r[0] for r in df.select(rk.deal_rule_risk(F.col("d"), F.col("o"))).collect()]
    assert got == [0.67, 0.45, 0.472, 0.12]


def test_priority_thresholds_inclusive(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.4,), (0.3999,)], "s double")
    assert [r[0] for r in df.select(priority_label(F.col("s"))).collect()] == \
        ["High", "Medium", "Medium", "Low"]


def test_score_leads_listed_and_error(spark, crm):
    ids = crm.leads.select("lead_id").limit(0)
    try:
        rk.score_leads(crm.leads, ids)
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
    some = crm.leads.where("converted").select("lead_id")
    out = rk.score_leads(crm.leads, some)
    assert out.count() == some.count()
    assert out.agg(F.min("score"), F.max("score")).first()[0] >= 0


def test_dense_codes_many_equal_single(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x"), ("a", "w"), (None, "z")],
                               "p string, q string")
    many = rk.dense_codes_many(df, ["p", "q"], "code")
    for col in ("p", "q"):
        one = sorted(tuple(r) for r in rk.dense_codes(df, col, "code").collect())
        assert sorted(tuple(r) for r in many[col].collect()) == one


def test_counting_rank_splits_a_hot_score_and_orders_nulls(spark):
    """A third of the rows on one score, cut into many id ranges; null scores last, null ids first."""
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") != 7, F.format_string("ID%05d", (F.col("id") * 7919) % n)).alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).when(F.col("id") % 101 != 0, F.round(F.rand(7), 2)).alias("score"))
    rows = [tuple(r) for r in df.collect()]
    df = spark.createDataFrame(rows, "key string, score double").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or ""))
    for every in (1, 16, rk.BOUND_EVERY):
        got = {(r["key"], r["score"]): r["rank"] for r in rk.counting_rank(df, "score", "key", every=every).collect()}
        assert got == {r: i + 1 for i, r in enumerate(want)}
    assert rk.counting_rank(df.limit(0), "score", "key").count() == 0


def test_every_window_of_the_counting_rank_is_cut_by_score_and_id_range(spark):
    """The rows' window is partitioned by (score, id range); the other runs over the groups' counts."""
    df = spark.range(20000).select(F.format_string("ID%06d", "id").alias("key"), F.lit(0.5).alias("score"))
    placed = rk.with_id_ranges(df, "score", "key", every=500)
    n, largest = placed.groupBy("__s", "__g").count().agg(F.count("*"), F.max("count")).first()
    assert n > 20 and largest < 20000 / 4


def test_ranking_starts_no_job_while_it_is_defined(spark, crm):
    sc = spark.sparkContext
    views = crm.leads, crm.deals, crm.reps  # opening the tables reads their footers
    sc.setJobGroup("define-ranks", "ranks")
    try:
        leads, deals = rk.score_leads(views[0]), rk.score_deals(*views[1:])
        assert list(sc.statusTracker().getJobIdsForGroup("define-ranks")) == []
        leads.count()
        assert list(sc.statusTracker().getJobIdsForGroup("define-ranks"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    for df in (leads, deals):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ExistingRDD" not in plan and "RepartitionByExpression" not in plan
