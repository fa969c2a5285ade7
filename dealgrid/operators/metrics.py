"""Revenue, churn, funnel and generator-report metrics.

Ratios of integers are rounded with ``half_up_ratio`` (exact integer
arithmetic) so the results do not depend on double rounding.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealgrid.functions.core import count_if, half_up_ratio
from dealgrid.schemas import DEAL_STAGES

# ---------------------------------------------------------------------------
# Month grid and MRR series
# ---------------------------------------------------------------------------


def month_grid(customers: DataFrame) -> DataFrame:
    """Monthly points from the earliest start date to the latest start or churn
    date.  Each point is the previous one plus a month (a day 29-31 clamps and
    stays clamped, e.g. 01-31, 02-29, 03-29), ``point_no`` 0-based.

    One row per month of the data's time span: bounded by the calendar, so the
    grid is safe to broadcast.
    """
    b = customers.agg(F.min("start_date").alias("lo"),
                      F.greatest(F.max("start_date"), F.max("churn_date")).alias("hi"))
    n = (F.floor(F.months_between("hi", "lo")) + 2).cast("int")
    pts = F.aggregate(F.sequence(F.lit(1), n), F.array(F.col("lo")),
                      lambda acc, i: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), 1))))
    g = b.where(F.col("lo").isNotNull()).select("hi", F.posexplode(pts).alias("point_no", "point"))
    return g.where(F.col("point") <= F.col("hi")).select("point_no", "point")


def mrr_timeseries(customers: DataFrame) -> DataFrame:
    """(month, mrr): MRR of the customers active at each grid point
    (start_date <= point < churn_date), month = the point's first day; 0 when none.

    Plan: each customer becomes two delta rows, +mrr at the first grid point on
    or after its start and -mrr at the first on or after its churn date; a point
    is found by an equi-join on the calendar month against the (broadcast,
    calendar-bounded) grid.  The deltas are summed per point (partial
    aggregation: at most one row per point leaves each task) and a running sum
    over the grid gives the series.  Work is linear in customers, not in
    customers x months.
    """
    grid = month_grid(customers)
    w_next = Window.orderBy("point_no")
    g = grid.select("point_no", "point", F.trunc("point", "month").alias("gmonth"),
                    F.lead("point").over(w_next).alias("next_point"),
                    F.lead("point_no").over(w_next).alias("next_no"))
    active = customers.where(F.col("start_date").isNotNull() & F.col("mrr").isNotNull() & (
        F.col("churn_date").isNull() | (F.col("churn_date") > F.col("start_date"))))
    # one pass: +mrr at the start, -mrr at the churn date (when there is one)
    deltas = active.select(F.explode(F.array(
        F.struct(F.col("start_date").alias("d"), F.col("mrr").cast("long").alias("delta")),
        F.struct(F.col("churn_date").alias("d"), (-F.col("mrr")).cast("long").alias("delta")))
    ).alias("e")).select("e.d", "e.delta").where(F.col("d").isNotNull())
    j = deltas.join(F.broadcast(g), F.trunc(deltas.d, "month") == g.gmonth, "inner")
    j = j.select(F.when(F.col("d") <= F.col("point"), F.col("point_no"))
                 .otherwise(F.col("next_no")).alias("at_no"), "delta")
    per_point = j.where(F.col("at_no").isNotNull()).groupBy("at_no").agg(
        F.sum("delta").alias("delta"))
    series = grid.join(per_point, grid.point_no == per_point.at_no, "left")
    w = Window.orderBy("point_no").rowsBetween(Window.unboundedPreceding, 0)
    return series.select(
        "point_no",
        F.trunc("point", "month").alias("month"),
        F.sum(F.coalesce("delta", F.lit(0))).over(w).cast("long").alias("mrr"))


def mrr_change(series: DataFrame) -> DataFrame:
    """(current_month, prior_month, change_pct) from the last two points;
    change 0 when fewer than two points or the prior MRR is 0."""
    last2 = series.orderBy(F.col("point_no").desc()).limit(2)
    one = last2.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("mrr", "point_no").alias("cur"),
        F.min_by("mrr", "point_no").alias("prior"))
    ok = (F.col("n") >= 2) & (F.col("prior") != 0)
    change = F.when(ok, half_up_ratio("cur - prior", "prior", 1, scale=100)).otherwise(F.lit(0.0))
    return one.select(
        F.when(F.col("n") >= 2, F.col("cur")).otherwise(F.lit(0)).cast("double").alias("current_month"),
        F.when(F.col("n") >= 2, F.col("prior")).otherwise(F.lit(0)).cast("double").alias("prior_month"),
        change.alias("change_pct"))


# ---------------------------------------------------------------------------
# Reporting queries
# ---------------------------------------------------------------------------

def churn_by_tier(customers: DataFrame) -> DataFrame:
    agg = customers.groupBy("subscription_tier").agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_if(F.col("churn_date").isNotNull()).alias("churned"))
    return agg.select("subscription_tier", "total_customers", "churned",
                      half_up_ratio("churned", "total_customers", 1, scale=100)
                      .alias("churn_rate_pct")) \
        .orderBy(F.col("churn_rate_pct").desc(), "subscription_tier")


def stage_order(col: Column) -> Column:
    out = None
    for i, s in enumerate(DEAL_STAGES, start=1):
        out = F.when(col == s, i) if out is None else out.when(col == s, i)
    return out


def pipeline_summary(deals: DataFrame) -> DataFrame:
    agg = deals.groupBy("stage").agg(
        F.count(F.lit(1)).alias("deal_count"),
        F.sum("value").cast("long").alias("total_value"),
        F.count("value").alias("_n"))
    return agg.select("stage", "deal_count", "total_value",
                      half_up_ratio("total_value", "_n", 0).alias("avg_value"),
                      stage_order(F.col("stage")).alias("stage_order")) \
        .orderBy(F.col("stage_order").asc_nulls_last(), "stage")


def last_month_start(as_of: Column) -> Column:
    return F.add_months(F.trunc(as_of, "month"), -1)


def deal_velocity_sql(deals: DataFrame, as_of: dt.date) -> DataFrame:
    """The same query through the SQL API with a bound date parameter."""
    return deals.sparkSession.sql(
        """SELECT trunc(close_date, 'month') AS month,
                  CAST(sum(datediff(close_date, created_at)) AS BIGINT) AS _s,
                  count(datediff(close_date, created_at)) AS _n
           FROM {deals}
           WHERE outcome != 'open' AND close_date >= add_months(trunc(:as_of, 'month'), -1)
           GROUP BY 1""", args={"as_of": as_of}, deals=deals) \
        .where(F.col("_n") > 0) \
        .select("month", half_up_ratio("_s", "_n", 0).cast("long").alias("avg_velocity_days")) \
        .orderBy("month")


def deal_velocity(deals: DataFrame, as_of: dt.date | Column | None = None) -> DataFrame:
    """(month, avg_velocity_days) for deals closed since the first day of last
    month (relative to ``as_of``; default: the latest close date in the data)."""
    if as_of is None:
        as_of = deals.agg(F.max("close_date")).scalar()
    elif isinstance(as_of, dt.date):
        as_of = F.lit(as_of)
    closed = deals.where((F.col("outcome") != "open") &
                         (F.col("close_date") >= last_month_start(as_of)))
    agg = closed.groupBy(F.trunc("close_date", "month").alias("month")).agg(
        F.sum(F.datediff("close_date", "created_at")).alias("_s"),
        F.count(F.datediff("close_date", "created_at")).alias("_n"))
    return agg.where(F.col("_n") > 0).select(
        "month", half_up_ratio("_s", "_n", 0).cast("long").alias("avg_velocity_days")) \
        .orderBy("month")


def channel_conversion(leads: DataFrame) -> DataFrame:
    agg = leads.groupBy("source").agg(F.sum(F.col("converted").cast("int")).alias("_c"),
                                      F.count("converted").alias("_n"))
    return agg.select("source", half_up_ratio("_c", "_n", 1, scale=100).alias("conversion_rate_pct"))


def channel_conversion_top(leads: DataFrame, n: int = 3) -> DataFrame:
    return channel_conversion(leads).orderBy(F.col("conversion_rate_pct").desc(), "source").limit(n)


def open_pipeline_value(deals: DataFrame) -> DataFrame:
    return deals.where(F.col("outcome") == "open").agg(
        F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("open_pipeline_value"))


def class_balance(labels: DataFrame, label: str) -> DataFrame:
    """(negatives, positives, scale_pos_weight = negatives / positives)."""
    agg = labels.agg(count_if(F.col(label) == 0).alias("negatives"),
                     count_if(F.col(label) == 1).alias("positives"))
    return agg.select("negatives", "positives",
                      F.try_divide(F.col("negatives").cast("double"),
                                   F.nullif(F.col("positives"), F.lit(0)).cast("double"))
                      .alias("scale_pos_weight"))


def conversion_by_attr(leads: DataFrame) -> DataFrame:
    """Conversion rate by source and by company size in one pass (GROUPING SETS)."""
    agg = leads.groupingSets([["source"], ["company_size"]], "source", "company_size").agg(
        F.sum(F.col("converted").cast("int")).alias("_c"), F.count("converted").alias("_n"),
        F.grouping_id().alias("_g"))
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("source")).otherwise(F.lit("company_size")).alias("attribute"),
        F.when(F.col("_g") == 1, F.col("source")).otherwise(F.col("company_size")).alias("value"),
        half_up_ratio("_c", "_n", 3).alias("conversion_rate"))


def win_rate_by_rep(deals: DataFrame, n: int = 5) -> DataFrame:
    closed = deals.where(F.col("outcome") != "open")
    agg = closed.groupBy("rep_id").agg(count_if(F.col("outcome") == "closed_won").alias("_w"),
                                       F.count(F.lit(1)).alias("closed_deals"))
    return agg.select("rep_id", "closed_deals", half_up_ratio("_w", "closed_deals", 3)
                      .alias("win_rate")).orderBy(F.col("win_rate").desc(), "rep_id").limit(n)


def deal_summary(deals: DataFrame) -> DataFrame:
    o = F.col("outcome")
    agg = deals.agg(F.count(F.lit(1)).alias("deals"),
                    count_if(o == "closed_won").alias("won"),
                    count_if(o == "closed_lost").alias("lost"),
                    count_if(o == "open").alias("open"),
                    F.sum("value").cast("long").alias("_v"), F.count("value").alias("_nv"))
    return agg.select("deals", "won", "lost", "open",
                      half_up_ratio("won", "won + lost", 3).alias("win_rate"),
                      half_up_ratio("_v", "_nv", 0).alias("avg_value"))


def event_mix(engagement: DataFrame) -> DataFrame:
    """Share of each event type (3 places), with total events, distinct deals and
    events per deal on every row.  One pass over the events: grouping sets by type
    and by deal, then the deals' groups are counted into one row; the window spans
    only that row and one row per event type."""
    sets = engagement.groupingSets([["event_type"], ["deal_id"]], "event_type", "deal_id").agg(
        F.grouping("event_type").alias("_by_deal"), F.count(F.lit(1)).alias("_n"))
    few = sets.groupBy("_by_deal", "event_type").agg(F.sum("_n").alias("events_of_type"),
                                                     F.count("deal_id").alias("_deals"))
    w = Window.partitionBy(F.lit(0))
    j = few.withColumn("events", F.sum(F.when(F.col("_by_deal") == 0, F.col("events_of_type"))).over(w)) \
           .withColumn("deals", F.sum("_deals").over(w)).where(F.col("_by_deal") == 0)
    return j.select("event_type", "events_of_type",
                    half_up_ratio("events_of_type", "events", 3).alias("share"),
                    F.col("events").cast("long").alias("events"),
                    F.col("deals").cast("long").alias("deals"),
                    half_up_ratio("events", "deals", 1).alias("events_per_deal"))


def meeting_rate_by_outcome(engagement: DataFrame, deals: DataFrame) -> DataFrame:
    """Engagement INNER deals(deal_id, outcome): share of meetings per outcome.
    Events are first counted per deal (combined map-side), so the join sees one
    row per deal."""
    per = engagement.groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("_e"), count_if(F.col("event_type") == "meeting").alias("_m"))
    j = per.join(deals.select("deal_id", "outcome"), "deal_id")
    agg = j.groupBy("outcome").agg(F.sum("_m").alias("_m"), F.sum("_e").alias("_e"))
    return agg.select("outcome", half_up_ratio("_m", "_e", 3).alias("meeting_rate"))


def churn_profile(customers: DataFrame) -> DataFrame:
    """Long form (metric, key, value): churn share by tier (3 places), churn
    reasons among churned customers (counts), average MRR by tier (0 places)."""
    by_tier = customers.groupBy("subscription_tier").agg(
        count_if(F.col("churn_date").isNotNull()).alias("_c"), F.count(F.lit(1)).alias("_n"),
        F.sum("mrr").alias("_s"), F.count("mrr").alias("_nm"))
    share = by_tier.select(F.lit("churn_share").alias("metric"),
                           F.col("subscription_tier").alias("key"),
                           half_up_ratio("_c", "_n", 3).alias("value"))
    avg_mrr = by_tier.select(F.lit("avg_mrr").alias("metric"), F.col("subscription_tier").alias("key"),
                             half_up_ratio("_s", "_nm", 0).alias("value"))
    reasons = customers.where(F.col("churn_reason").isNotNull()).groupBy("churn_reason").agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("churn_reason").alias("metric"), F.col("churn_reason").alias("key"), "value")
    return share.unionByName(reasons).unionByName(avg_mrr)


def dataset_summary(t: dict[str, DataFrame]) -> DataFrame:
    """(metric, value): one aggregate per table, its columns turned into rows."""
    leads = t["leads"].agg(F.count(F.lit(1)).alias("leads"),
                           count_if(F.col("converted")).alias("leads_converted"))
    leads = leads.withColumn("leads_converted_share", half_up_ratio("leads_converted", "leads", 3))
    deals = t["deals"].agg(F.count(F.lit(1)).alias("deals"),
                           count_if(F.col("outcome") == "closed_won").alias("deals_won"))
    events = t["engagement"].agg(F.count(F.lit(1)).alias("engagement_events"))
    cust = t["customers"].agg(F.count(F.lit(1)).alias("customers"),
                              count_if(F.col("churn_date").isNotNull()).alias("customers_churned"))
    out = None
    for df in (leads, deals, events, cust):
        part = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                            for c in df.columns])))
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------
# Checks of the generating rules (re-aimed generator reports)
# ---------------------------------------------------------------------------

def tier_from_size(col: Column) -> Column:
    return (F.when(col.isin("1-10", "11-50"), "starter").when(col == "51-200", "growth")
            .when(col == "201-1000", "enterprise"))


def customers_from_won(deals: DataFrame, leads: DataFrame) -> DataFrame:
    """Won deals INNER leads(lead_id, company_size) -> subscription skeleton."""
    won = deals.where(F.col("outcome") == "closed_won").select("deal_id", "lead_id", "close_date")
    j = won.join(leads.select("lead_id", "company_size"), "lead_id")
    return j.select("deal_id", "lead_id", tier_from_size(F.col("company_size"))
                    .alias("subscription_tier"), F.col("close_date").alias("start_date"))


def channel_for(event_type: Column) -> Column:
    """Expected channel(s) of an event type: email_* -> email, call -> phone,
    meeting -> zoom or in_person."""
    return (F.when(event_type.isin("email_sent", "email_reply"), F.array(F.lit("email")))
            .when(event_type == "call", F.array(F.lit("phone")))
            .when(event_type == "meeting", F.array(F.lit("zoom"), F.lit("in_person"))))


def channel_mix(engagement: DataFrame) -> DataFrame:
    agg = engagement.groupBy("event_type", "channel").agg(F.count(F.lit(1)).alias("events"))
    ok = F.coalesce(F.array_contains(channel_for(F.col("event_type")), F.col("channel")), F.lit(False))
    return agg.select("event_type", "channel", "events", ok.alias("channel_matches_type"))


def stale_win_rate(deals: DataFrame) -> DataFrame:
    """Closed deals: win rate when the last contact was more than 14 days before
    the close ('stale') versus not."""
    closed = deals.where(F.col("outcome") != "open")
    stale = F.datediff("close_date", "last_contact_date") > 14
    agg = closed.groupBy(stale.alias("stale")).agg(
        F.count(F.lit(1)).alias("closed_deals"),
        count_if(F.col("outcome") == "closed_won").alias("_w"))
    return agg.select("stale", "closed_deals", half_up_ratio("_w", "closed_deals", 3).alias("win_rate"))


def cold_window_reply(engagement: DataFrame, deals: DataFrame) -> DataFrame:
    """Lost deals: share of replies among events in the last 7 days before the
    deal's end versus earlier events."""
    lost = deals.where(F.col("outcome") == "closed_lost").select(
        "deal_id", F.coalesce("close_date", "last_contact_date").alias("_end"))
    # events counted per (deal, day) first: the join sees one row per active day
    per_day = engagement.groupBy("deal_id", "timestamp").agg(
        F.count(F.lit(1)).alias("_e"), count_if(F.col("event_type") == "email_reply").alias("_r"))
    j = per_day.join(lost, "deal_id")
    cold = F.col("timestamp") >= F.date_sub("_end", 7)
    agg = j.groupBy(cold.alias("cold_window")).agg(F.sum("_e").cast("long").alias("events"),
                                                    F.sum("_r").alias("_r"))
    return agg.select("cold_window", "events", half_up_ratio("_r", "events", 3).alias("reply_share"))


def monthly_conversion(leads: DataFrame) -> DataFrame:
    agg = leads.groupBy(F.month("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("leads"), F.sum(F.col("converted").cast("int")).alias("_c"))
    return agg.select("month", "leads", half_up_ratio("_c", "leads", 3).alias("conversion_rate"))


def tenure_churn_curve(customers: DataFrame) -> DataFrame:
    """Churned customers by tenure in whole months."""
    churned = customers.where(F.col("churn_date").isNotNull())
    tenure = F.floor(F.months_between("churn_date", "start_date")).cast("int")
    return churned.groupBy(tenure.alias("tenure_months")).agg(
        F.count(F.lit(1)).alias("churned_customers"))


def deals_from_converted(leads: DataFrame) -> DataFrame:
    """Converted leads -> deal skeleton, one per lead, created when converted."""
    return leads.where(F.col("converted")).select(
        "lead_id", F.col("converted_at").alias("created_at"),
        F.col("conversion_value").alias("value"))


def velocity_stats(deals: DataFrame) -> DataFrame:
    """Cycle length (close - created, days) of closed deals: mean, sample sd, min, max."""
    closed = deals.where(F.col("outcome") != "open")
    days = F.datediff("close_date", "created_at")
    agg = closed.agg(F.count(days).alias("closed_deals"), F.sum(days).alias("_s"),
                     F.stddev_samp(days).alias("_sd"), F.min(days).alias("min_days"),
                     F.max(days).alias("max_days"))
    return agg.select("closed_deals", half_up_ratio("_s", "closed_deals", 1).alias("mean_days"),
                      F.round("_sd", 3).alias("sd_days"), "min_days", "max_days")
