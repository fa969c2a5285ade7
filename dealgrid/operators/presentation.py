"""Page-level data: score tables, filters, option lists, cards, alerts, labels.

All of it is DataFrame work over the scored tables; the pages only display rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.core import count_if, half_up_ratio, money, pretty_label
from dealgrid.operators.ranking import dense_codes_many
from dealgrid.schemas import AT_RISK_THRESHOLD, CRITICAL_THRESHOLD, HIGH_PRIORITY, MEDIUM_PRIORITY

ALL = "All"
FILTER_COLUMNS = ["source", "industry", "company_size"]


def priority_label(score: Column) -> Column:
    """High at or above 0.7, Medium at or above 0.4, else Low."""
    return F.when(score >= HIGH_PRIORITY, "High").when(score >= MEDIUM_PRIORITY, "Medium") \
        .otherwise("Low")


def lead_scores(leads: DataFrame, scores: DataFrame) -> DataFrame:
    """Leads INNER scores on lead_id, best rank first."""
    return leads.select("lead_id", "source", "company_size", "industry", "converted") \
        .join(scores, "lead_id", "inner").orderBy("rank")


def apply_filters(df: DataFrame, source: str = ALL, industry: str = ALL,
                  size: str = ALL) -> DataFrame:
    """Equality filters; ``All`` disables a filter."""
    for col, val in (("source", source), ("industry", industry), ("company_size", size)):
        if val != ALL:
            df = df.where(F.col(col) == val)
    return df


def filter_options(df: DataFrame, columns: list[str] = FILTER_COLUMNS) -> DataFrame:
    """(filter_name, position, option): ``All`` first, then the sorted distinct values."""
    out = None
    all_codes = dense_codes_many(df, columns, "code")
    for col in columns:
        codes = all_codes[col].select(
            F.lit(col).alias("filter_name"), (F.col("code") + 1).alias("position"),
            F.col("value").alias("option"))
        head = df.sparkSession.range(1).select(F.lit(col).alias("filter_name"),
                                               F.lit(0).alias("position"), F.lit(ALL).alias("option"))
        part = head.unionByName(codes)
        out = part if out is None else out.unionByName(part)
    return out


def lead_priority_table(scored_leads: DataFrame) -> DataFrame:
    """Display table: selected, relabelled and renamed columns."""
    return scored_leads.select(
        F.col("rank").alias("Rank"),
        priority_label(F.col("score")).alias("Priority"),
        F.col("lead_id").alias("Lead ID"),
        pretty_label("source").alias("Source"),
        pretty_label("industry").alias("Industry"),
        F.col("company_size").alias("Company Size"),
        F.col("score").alias("Score"),
        F.col("converted").alias("Converted")).orderBy("Rank")


def _score_units(col: str = "score") -> Column:
    """Scores are 4-place decimals: as integer ten-thousandths they sum exactly."""
    return F.round(F.col(col) * 10000).cast("long")


def lead_cards(scored_leads: DataFrame) -> DataFrame:
    """total_leads, conversion_rate, avg_score, top_source (highest mean score;
    ties -> alphabetically first), one row."""
    agg = scored_leads.agg(F.count(F.lit(1)).alias("total_leads"),
                           F.sum(F.col("converted").cast("int")).alias("_c"),
                           F.sum(_score_units()).alias("_s"))
    by_src = scored_leads.groupBy("source").agg(F.sum(_score_units()).alias("_s"),
                                                F.count(F.lit(1)).alias("_n"))
    top = by_src.select("source", (F.col("_s") / F.col("_n")).alias("_m")) \
        .orderBy(F.col("_m").desc(), "source").limit(1)
    return agg.select("total_leads", half_up_ratio("_c", "total_leads", 4).alias("conversion_rate"),
                      half_up_ratio("_s", "total_leads * 10000", 6).alias("avg_score"),
                      top.select(pretty_label("source")).scalar().alias("top_source"))


def score_by_source(scored_leads: DataFrame) -> DataFrame:
    by_src = scored_leads.groupBy("source").agg(F.sum(_score_units()).alias("_s"),
                                                F.count(F.lit(1)).alias("_n"))
    return by_src.select(pretty_label("source").alias("source"),
                         half_up_ratio("_s", "_n * 10000", 6).alias("avg_score")) \
        .orderBy(F.col("avg_score").desc(), "source")


def score_distribution(scores: DataFrame, col: str) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max, rounded to 4 places.

    Quartiles use linear interpolation (``percentile``); scores carry 4 places,
    so the aggregation buffer holds at most 10,001 distinct values per task.
    """
    c = F.round(col, 4)  # scores carry 4 places: bounds the quantile buffer
    agg = scores.agg(F.count(c).alias("count"), F.sum(_score_units(col)).alias("_s"),
                     F.stddev_samp(c).alias("_sd"), F.min(c).alias("min"),
                     F.percentile(c, [0.25, 0.5, 0.75]).alias("_q"), F.max(c).alias("max"))
    return agg.select(F.col("count").cast("double").alias("count"),
                      half_up_ratio("_s", "count * 10000", 4).alias("mean"),
                      F.round("_sd", 4).alias("std"), F.round("min", 4).alias("min"),
                      F.round(F.col("_q")[0], 4).alias("p25"), F.round(F.col("_q")[1], 4).alias("p50"),
                      F.round(F.col("_q")[2], 4).alias("p75"), F.round("max", 4).alias("max"))


def deal_risk_table(active: DataFrame, open_scores: DataFrame) -> DataFrame:
    """Active deals LEFT open-deal scores (missing -> 0.0), at_risk (> 0.7) and
    critical (> 0.8) flags, highest risk first."""
    j = active.join(open_scores.select("deal_id", "risk_score"), "deal_id", "left")
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    return j.withColumn("risk_score", risk) \
        .withColumn("at_risk", risk > AT_RISK_THRESHOLD) \
        .withColumn("critical", risk > CRITICAL_THRESHOLD) \
        .orderBy(F.col("risk_score").desc(), "deal_id")


def risk_cards(risk: DataFrame) -> DataFrame:
    agg = risk.agg(F.count(F.lit(1)).alias("open_deals"),
                   count_if(F.col("at_risk")).alias("at_risk_deals"),
                   F.sum("days_since_last_contact").alias("_d"),
                   F.count("days_since_last_contact").alias("_nd"),
                   F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total_pipeline_value"))
    return agg.select("open_deals", "at_risk_deals",
                      F.coalesce(half_up_ratio("at_risk_deals", "open_deals", 4), F.lit(0.0))
                      .alias("at_risk_share"),
                      half_up_ratio("_d", "_nd", 2).alias("avg_days_since_contact"),
                      "total_pipeline_value")


# FIXED VALUES: alert line format (deal, rep, value, days silent, score)
ALERT_FORMAT = "**%s** — %s · %s · %d days silent · Risk: %s"


def risk_alerts(risk: DataFrame) -> DataFrame:
    crit = risk.where(F.col("critical"))
    return crit.select("deal_id", F.format_string(
        ALERT_FORMAT, F.col("deal_id"), F.col("rep_name"), money("value"),
        F.col("days_since_last_contact"), F.format_number("risk_score", 2)).alias("alert"))


def deal_risk_display(risk: DataFrame) -> DataFrame:
    """Display table of the deal-risk page: money and score formatted, renamed."""
    return risk.select(
        F.col("deal_id").alias("Deal ID"), F.col("rep_name").alias("Rep"),
        F.col("stage").alias("Stage"), money("value").alias("Value"),
        F.col("days_since_last_contact").alias("Days Silent"),
        F.col("engagement_count").alias("Engagements"),
        F.format_number("risk_score", 2).alias("Risk Score"), F.col("at_risk").alias("At Risk"))


def insight_label(insight_type: Column) -> Column:
    """``mrr`` -> ``MRR``, anything else capitalized."""
    return F.when(insight_type == "mrr", F.lit("MRR")).otherwise(
        F.concat(F.upper(F.substring(insight_type, 1, 1)), F.lower(F.substring(insight_type, 2, 2147483647))))


def insight_cards(insights: DataFrame) -> DataFrame:
    return insights.select("id", insight_label(F.col("insight_type")).alias("label"),
                           F.date_format("generated_at", "MMM dd, yyyy HH:mm").alias("generated"),
                           "summary")
