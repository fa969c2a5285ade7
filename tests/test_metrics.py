"""Metrics on hand-computed micro-frames: month grid drift, empty months,
churn on the start date, exact rounding, velocity window."""

import datetime as dt

from pyspark.sql import functions as F

from dealgrid.functions.core import half_up_ratio
from dealgrid.operators import metrics as me
from dealgrid.schemas import CUSTOMERS, DEALS

D = dt.date


def _cust(spark, rows):
    return spark.createDataFrame(
        [(f"C{i}", "X", tier, mrr, s, c, "price" if c else None)
         for i, (tier, mrr, s, c) in enumerate(rows)], CUSTOMERS)


def test_grid_from_day_31_drifts_and_stays(spark):
    cust = _cust(spark, [("starter", 10, D(2024, 1, 31), D(2024, 6, 15))])
    pts = [r["point"] for r in me.month_grid(cust).orderBy("point_no").collect()]
    # each point is the previous plus one month: clamped to the 29th and kept there
    assert pts == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 29), D(2024, 4, 29),
                   D(2024, 5, 29)]


def test_mrr_active_at_point_empty_month_and_churn_on_start(spark):
    cust = _cust(spark, [
        ("starter", 100, D(2024, 1, 10), D(2024, 2, 10)),   # active at 01-10 only
        ("growth", 1000, D(2024, 3, 5), D(2024, 5, 1)),     # counted at 03-10 and 04-10
        ("growth", 7, D(2024, 2, 1), D(2024, 2, 1)),        # churn = start: never active
    ])
    got = [(r["month"], r["mrr"]) for r in me.mrr_timeseries(cust).orderBy("point_no").collect()]
    # grid 01-10 .. 04-10 (ends at the latest start/churn date, 05-01); 02 has no one
    assert got == [(D(2024, 1, 1), 100), (D(2024, 2, 1), 0), (D(2024, 3, 1), 1000),
                   (D(2024, 4, 1), 1000)]


def test_mrr_matches_interval_join(spark):
    """Delta/running-sum plan equals the direct range-join definition on a
    bigger frame with many same-day starts and churns."""
    rows = []
    for i in range(300):
        s = D(2023, 1, 1) + dt.timedelta(days=(i * 37) % 500)
        c = None if i % 3 == 0 else s + dt.timedelta(days=(i * 11) % 400)
        rows.append(("starter", 10 + i, s, c))
    cust = _cust(spark, rows)
    grid = me.month_grid(cust)
    direct = grid.join(cust, (cust.start_date <= grid.point) & (
        cust.churn_date.isNull() | (cust.churn_date > grid.point)), "left") \
        .groupBy("point_no").agg(F.coalesce(F.sum("mrr"), F.lit(0)).alias("mrr"))
    a = {r["point_no"]: r["mrr"] for r in direct.collect()}
    b = {r["point_no"]: r["mrr"] for r in me.mrr_timeseries(cust).collect()}
    assert a == b


def test_mrr_change_edge_cases(spark):
    s = spark.createDataFrame([(0, D(2024, 1, 1), 0), (1, D(2024, 2, 1), 50)],
                              "point_no int, month date, mrr long")
    r = me.mrr_change(s).first()
    assert (r["current_month"], r["prior_month"], r["change_pct"]) == (50.0, 0.0, 0.0)
    one = s.where("point_no = 0")
    assert me.mrr_change(one).first()["change_pct"] == 0.0


def test_half_up_ratio_exact_ties(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (49, 400), (1, 3), (7, 0)], "n long, d long")
    got = [r[0] for r in df.select(half_up_ratio("n", "d", 0)).collect()]
    assert got == [3.0, -3.0, 0.0, 0.0, None]
    pct = [r[0] for r in df.select(half_up_ratio("n", "d", 1, scale=100)).collect()]
    assert pct[2] == 12.3  # 12.25 rounds half up exactly (a double would give 12.2)


def test_pipeline_summary_order_and_rounding(spark):
    base = (D(2024, 1, 1), D(2024, 1, 2), None)
    rows = [("D1", "L1", "R", "p", "proposal", *base, 3, "open"),
            ("D2", "L2", "R", "p", "proposal", *base, 4, "open"),
            ("D3", "L3", "R", "p", "prospecting", *base, 1, "open")]
    out = me.pipeline_summary(spark.createDataFrame(rows, DEALS)).collect()
    assert [(r["stage"], r["deal_count"], r["total_value"], r["avg_value"]) for r in out] == [
        ("prospecting", 1, 1, 1.0), ("proposal", 2, 7, 4.0)]


def test_deal_velocity_window(spark):
    rows = [("D1", "L", "R", "p", "closed_won", D(2024, 5, 1), D(2024, 5, 2), D(2024, 5, 11), 1, "closed_won"),
            ("D2", "L", "R", "p", "closed_lost", D(2024, 4, 1), D(2024, 4, 2), D(2024, 4, 30), 1, "closed_lost"),
            ("D3", "L", "R", "p", "closed_lost", D(2024, 1, 1), D(2024, 1, 2), D(2024, 3, 30), 1, "closed_lost")]
    out = me.deal_velocity(spark.createDataFrame(rows, DEALS), D(2024, 5, 20)).collect()
    assert [(r["month"], r["avg_velocity_days"]) for r in out] == [(D(2024, 4, 1), 29), (D(2024, 5, 1), 10)]


def test_crm_counts_match_fixture_notes(crm):
    assert crm.reps.count() == 10
    assert crm.leads.count() == 1500
    assert crm.deals.count() == 797
    assert crm.engagement.count() == 3255
    assert crm.customers.count() == 246


def test_referral_converts_more_than_paid_search(crm):
    rates = {r["value"]: r["conversion_rate"]
             for r in me.conversion_by_attr(crm.leads).where("attribute = 'source'").collect()}
    assert rates["referral"] > rates["paid_search"]


def test_starter_churns_more_than_enterprise(crm):
    share = {r["key"]: r["value"] for r in me.churn_profile(crm.customers)
             .where("metric = 'churn_share'").collect()}
    assert share["starter"] > share["enterprise"]


def test_hot_deal_holding_a_third_of_events(spark):
    """Per-deal aggregation and the window checks stay exact when one deal holds
    a third of all events (they are combined map-side before any join)."""
    from dealgrid.operators import features as fe
    from dealgrid.operators import quality as dq
    from dealgrid.schemas import ENGAGEMENT
    n = 3000
    ev = spark.range(n).select(
        F.format_string("E%d", "id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.format_string("D%d", F.col("id") % 50))
        .alias("deal_id"),
        F.when(F.col("id") % 2 == 0, F.lit("meeting")).otherwise(F.lit("call")).alias("event_type"),
        F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("timestamp"),
        F.lit("zoom").alias("channel"))
    ev = spark.createDataFrame(ev.rdd, ENGAGEMENT)
    per = {r["deal_id"]: r["engagement_count"] for r in fe.engagement_per_deal(ev).collect()}
    assert per["HOT"] == n // 3
    deals = spark.createDataFrame(
        [("HOT", "L", "R", "p", "closed_won", D(2024, 1, 10), D(2024, 1, 20), D(2024, 1, 25), 1, "closed_won")],
        DEALS)
    c = {r["check_name"]: r["bad_rows"] for r in dq.validate_engagement(ev, deals).collect()}
    hot_days = [(i % 40) for i in range(0, n, 3)]
    assert c["before_deal_start"] == sum(1 for d in hot_days if d < 9)
    assert c["after_deal_end"] == sum(1 for d in hot_days if d > 24)
    assert c["missing_deal"] == n - n // 3
