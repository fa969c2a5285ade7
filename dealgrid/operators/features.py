"""Feature tables for the two models, and the open-deal views.

Engagement is aggregated per deal *before* it meets the deals (partial/final
aggregation: a deal with a huge number of events is combined map-side), so the
join input is one row per deal, not one row per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.core import count_if
from dealgrid.operators.ranking import dense_codes_many


def engagement_per_deal(engagement: DataFrame) -> DataFrame:
    """(deal_id, engagement_count, meeting_count, reply_count, sent_count)."""
    et = F.col("event_type")
    return engagement.groupBy("deal_id").agg(
        F.count("event_id").alias("engagement_count"),
        count_if(et == "meeting").alias("meeting_count"),
        count_if(et == "email_reply").alias("reply_count"),
        count_if(et == "email_sent").alias("sent_count"))


def _with_engagement(deals: DataFrame, engagement: DataFrame) -> DataFrame:
    """Deals LEFT engagement summary: deals without events get zero counts."""
    per = engagement_per_deal(engagement)
    j = deals.join(per, "deal_id", "left")
    for c in ["engagement_count", "meeting_count", "reply_count", "sent_count"]:
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    rate = F.coalesce(F.try_divide(F.col("reply_count").cast("double"),
                                   F.nullif(F.col("sent_count"), F.lit(0)).cast("double")),
                      F.lit(0.0))
    return j.withColumn("email_reply_rate", rate)


def lead_features(leads: DataFrame, mappings: dict[str, DataFrame] | None = None) -> DataFrame:
    """(lead_id, converted, lead_month, source_encoded, company_size_encoded,
    industry_encoded).  Codes are 0-based positions in the sorted distinct values
    (NULL -> -1).  Pass ``mappings`` (from ``category_mappings``) to reuse a
    persisted mapping; values it does not know get -1."""
    mappings = mappings or category_mappings(leads)
    out = leads.select("lead_id", F.col("converted").cast("int").alias("converted"),
                       F.month("created_at").alias("lead_month"),
                       "source", "company_size", "industry")
    for col in ["source", "company_size", "industry"]:
        m = mappings[col].withColumnRenamed("value", f"_{col}")
        out = out.join(m, out[col] == m[f"_{col}"], "left").drop(f"_{col}")
        out = out.withColumn(f"{col}_encoded", F.coalesce(F.col("code"), F.lit(-1)).cast("int")) \
                 .drop("code")
    return out.select("lead_id", "converted", "lead_month", "source_encoded",
                      "company_size_encoded", "industry_encoded")


def category_mappings(leads: DataFrame) -> dict[str, DataFrame]:
    return dense_codes_many(leads, ["source", "company_size", "industry"], "code")


def deal_features(deals: DataFrame, engagement: DataFrame) -> DataFrame:
    """Closed deals with label ``is_at_risk`` (closed_lost = 1)."""
    closed = deals.where(F.col("outcome") != "open")
    j = _with_engagement(closed, engagement)
    return j.select(
        "deal_id",
        F.col("value").alias("deal_value"),
        F.datediff("last_contact_date", "created_at").alias("deal_age_days"),
        F.datediff("close_date", "last_contact_date").alias("days_since_last_contact"),
        "engagement_count", "meeting_count", "email_reply_rate",
        (F.col("outcome") == "closed_lost").cast("int").alias("is_at_risk"))


def latest_contact(deals: DataFrame):
    """Scalar subquery: latest last_contact_date over all deals."""
    return deals.agg(F.max("last_contact_date")).scalar()


def open_deals_base(deals: DataFrame, engagement: DataFrame) -> DataFrame:
    """Open deals with their engagement summary and silence (days since the
    latest contact in the data).  Active-deal view and open-deal features are
    both derived from this one frame, so one plan computes the engagement
    aggregation once (the shared subtree is a reused exchange)."""
    opened = deals.where(F.col("outcome") == "open")
    j = _with_engagement(opened, engagement)
    return j.withColumn("days_since_last_contact",
                        F.datediff(latest_contact(deals), F.col("last_contact_date")))


def open_deal_features(deals: DataFrame, engagement: DataFrame,
                       base: DataFrame | None = None) -> DataFrame:
    """Open deals, no label; silence measured against the latest contact date in the data."""
    j = base if base is not None else open_deals_base(deals, engagement)
    return j.select(
        "deal_id",
        F.col("value").alias("deal_value"),
        F.datediff("last_contact_date", "created_at").alias("deal_age_days"),
        "days_since_last_contact",
        "engagement_count", "meeting_count", "email_reply_rate")


def active_deals(deals: DataFrame, reps: DataFrame, engagement: DataFrame,
                 base: DataFrame | None = None) -> DataFrame:
    """Open deals with rep name and engagement summary, oldest contact first."""
    # engagement first: both sides are keyed by deal_id (co-located when the
    # tables are bucketed by it); the rep dimension is joined afterwards
    j = base if base is not None else open_deals_base(deals, engagement)
    r = reps.select(F.col("rep_id").alias("_rid"), F.col("name").alias("rep_name"))
    j = j.join(r, j.rep_id == r._rid, "inner")
    return j.select(
        "deal_id", "rep_id", "rep_name", "product", "stage", "value", "created_at",
        "last_contact_date", "days_since_last_contact", "engagement_count", "meeting_count",
    ).orderBy("last_contact_date", "deal_id")
