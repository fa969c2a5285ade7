"""Daily metrics snapshot, rule-based insights, response parsing, insight table.

The snapshot is one row built from five one-row aggregations combined as
scalar subqueries (no join).  Insights are typed rows ``(insight_type, summary)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.functions.core import strip_ws
from dealgrid.operators import metrics as me
from dealgrid.schemas import AT_RISK_THRESHOLD

INSIGHT_SCHEMA = "array<struct<insight_type:string,summary:string>>"


def snapshot(spark: SparkSession, customers: DataFrame, deals: DataFrame, leads: DataFrame,
             risk_scores: DataFrame, as_of=None, scope: str = "closed") -> DataFrame:
    """One row: mrr{current_month, prior_month, change_pct}, churn_by_tier map,
    deal_velocity_days map (month -> days), top_acquisition_channels array,
    deals_at_risk{count, open_pipeline_value}.

    ``risk_scores`` has a ``risk_score`` column.  With ``scope="closed"`` it is
    the closed-deal scoring (the daily job's definition: the count comes from
    closed deals while the value is the whole open pipeline); with
    ``scope="open"`` pass the open-deal risk table (the page's definition).
    """
    mrr = me.mrr_change(me.mrr_timeseries(customers)).select(
        F.struct("current_month", "prior_month", "change_pct")).scalar()
    churn = me.churn_by_tier(customers).select(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("subscription_tier", "churn_rate_pct"))))).scalar()
    vel = me.deal_velocity(deals, as_of).select(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("month").cast("string"), "avg_velocity_days"))))).scalar()
    # the three best channels first (TakeOrdered), then gathered: at most 3 rows
    top = me.channel_conversion_top(leads, 3).select(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("conversion_rate_pct")).alias("k"), F.col("source"),
        F.col("conversion_rate_pct")))), 1, 3).alias("a")).select(
        F.transform("a", lambda s: F.struct(s["source"].alias("source"),
                                            s["conversion_rate_pct"].alias("conversion_rate_pct")))
    ).scalar()
    at_risk = risk_scores.agg(F.sum(F.when(F.col("risk_score") > AT_RISK_THRESHOLD, 1)
                                    .otherwise(0)).cast("long")).scalar()
    open_value = me.open_pipeline_value(deals).select("open_pipeline_value").scalar()
    return spark.range(1).select(
        mrr.alias("mrr"), F.coalesce(churn, F.create_map().cast("map<string,double>"))
        .alias("churn_by_tier"),
        F.coalesce(vel, F.create_map().cast("map<string,bigint>")).alias("deal_velocity_days"),
        top.alias("top_acquisition_channels"),
        F.struct(F.coalesce(at_risk, F.lit(0)).alias("count"),
                 open_value.alias("open_pipeline_value")).alias("deals_at_risk"),
        F.lit(scope).alias("at_risk_scope"))


def snapshot_json(snap: DataFrame) -> DataFrame:
    return snap.select(F.to_json(F.struct("mrr", "churn_by_tier", "deal_velocity_days",
                                          "top_acquisition_channels", "deals_at_risk"))
                       .alias("data_snapshot"))


def snapshot_leaves(snap: DataFrame) -> DataFrame:
    """(leaf, num_value, text_value): every leaf of the snapshot, for checking.
    Built as one array per snapshot row and inlined, so the snapshot (and its
    scalar aggregations) is evaluated once."""
    def leaf(name, num=None, text=None):
        return F.struct(name.alias("leaf"), (num if num is not None else F.lit(None))
                        .cast("double").alias("num_value"),
                        (text if text is not None else F.lit(None)).cast("string").alias("text_value"))
    fixed = F.array(*[leaf(F.lit(n), F.col(n)) for n in (
        "mrr.current_month", "mrr.prior_month", "mrr.change_pct",
        "deals_at_risk.count", "deals_at_risk.open_pipeline_value")])
    def map_leaves(m):
        return F.transform(F.map_entries(m), lambda e: leaf(
            F.concat(F.lit(m + "."), e["key"]), e["value"]))
    maps = [map_leaves(m) for m in ("churn_by_tier", "deal_velocity_days")]
    pre = "top_acquisition_channels."
    chans = F.flatten(F.transform("top_acquisition_channels", lambda c, i: F.array(
        leaf(F.concat(F.lit(pre), i.cast("string"), F.lit(".source")), text=c["source"]),
        leaf(F.concat(F.lit(pre), i.cast("string"), F.lit(".conversion_rate_pct")),
             c["conversion_rate_pct"]))))
    none = F.array().cast("array<struct<leaf:string,num_value:double,text_value:string>>")
    return snap.select(F.inline(F.concat(fixed, *maps, F.coalesce(chans, none))))


# Insight rules of this library: type -> (precedence, lower = more important; text)
RULES = {
    "deals": (1, "%d scored deals are above the %.1f risk threshold; open pipeline is $%s."),
    "mrr": (2, "MRR moved %.1f%% month over month, from $%s to $%s."),
    "churn": (3, "The %s tier churns most, at %.1f%% of customers."),
    "leads": (4, "%s leads convert best, at %.1f%%."),
    "pipeline": (5, "Deals closed in %s took %d days on average."),
}
MRR_ALERT_PCT = 5.0


def rule_insights(snap: DataFrame, n: int = 3) -> DataFrame:
    """(position, insight_type, summary): the n most important typed insights."""
    s = snap
    money = lambda c: F.format_number(c.cast("double"), 0)
    churn = F.array_sort(F.transform(F.map_entries("churn_by_tier"),
                                     lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("tier"),
                                                        e["value"].alias("rate"))))
    vel = F.array_sort(F.map_entries("deal_velocity_days"))
    cands = [
        ("deals", F.col("deals_at_risk.count") > 0,
         F.format_string(RULES["deals"][1], F.col("deals_at_risk.count"), F.lit(AT_RISK_THRESHOLD),
                         money(F.col("deals_at_risk.open_pipeline_value")))),
        ("mrr", F.abs(F.col("mrr.change_pct")) >= MRR_ALERT_PCT,
         F.format_string(RULES["mrr"][1], F.col("mrr.change_pct"), money(F.col("mrr.prior_month")),
                         money(F.col("mrr.current_month")))),
        ("churn", F.size("churn_by_tier") > 0,
         F.format_string(RULES["churn"][1], F.element_at(churn, 1)["tier"],
                         F.element_at(churn, 1)["rate"])),
        ("leads", F.size("top_acquisition_channels") > 0,
         F.format_string(RULES["leads"][1], F.element_at("top_acquisition_channels", 1)["source"],
                         F.element_at("top_acquisition_channels", 1)["conversion_rate_pct"])),
        ("pipeline", F.size("deal_velocity_days") > 0,
         F.format_string(RULES["pipeline"][1], F.element_at(vel, -1)["key"],
                         F.element_at(vel, -1)["value"])),
    ]
    arr = F.filter(F.array(*[F.struct(F.lit(RULES[t][0]).alias("prio"), F.lit(t).alias("insight_type"),
                                      text.alias("summary"), cond.alias("ok"))
                             for t, cond, text in cands]), lambda x: x["ok"])
    out = s.select(F.posexplode(F.slice(F.array_sort(arr), 1, n)).alias("p", "x"))
    return out.select((F.col("p") + 1).alias("position"), F.col("x.insight_type").alias("insight_type"),
                      F.col("x.summary").alias("summary"))


def render_responses(insights: DataFrame) -> DataFrame:
    """Response texts built from an insight list: plain JSON, fenced with and
    without a language tag, one item short, and cut-off JSON:
    (response_id, text)."""
    arr = insights.agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "insight_type", "summary"))),
                              lambda s: F.struct(s["insight_type"].alias("insight_type"),
                                                 s["summary"].alias("summary")))).alias("j"))
    j = F.col("j")
    fence = F.lit("```")
    rows = [
        (1, j),
        (2, F.concat(fence, F.lit("json\n"), j, F.lit("\n"), fence)),
        (3, F.concat(fence, F.lit("\n"), j, F.lit("\n"), fence)),
        (4, F.concat(F.lit("  "), j, F.lit("  "))),
        (5, F.regexp_replace(j, r",\{[^{}]*\}\]$", "]")),
        (6, F.expr("substring(j, 1, length(j) - 2)")),
    ]
    # one array over the single row: the insights are evaluated once
    return arr.select(F.inline(F.array(*[F.struct(F.lit(rid).alias("response_id"), text.alias("text"))
                                         for rid, text in rows])))


def _strip_fences(text):
    """Python-equal strip; when the text starts with a code fence, keep what lies
    between the first two fences, drop a leading ``json`` tag, strip again."""
    t = strip_ws(text)
    inner = F.split(t, "```", 3).getItem(1)
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2147483647)).otherwise(inner)
    return F.when(t.startswith("```"), strip_ws(inner)).otherwise(t)


def judged_responses(responses: DataFrame) -> DataFrame:
    """The response rows with ``items`` (the parsed list) and ``reason`` (null when accepted): the
    text (code fence removed) must be a JSON array of exactly three objects with both
    fields.  A null or empty text is no JSON array."""
    parsed = responses.withColumn("items", F.from_json(_strip_fences(F.col("text")), INSIGHT_SCHEMA))
    complete = F.forall("items", lambda x: x["insight_type"].isNotNull() & x["summary"].isNotNull())
    ok = F.col("items").isNotNull() & (F.size("items") == 3) & F.coalesce(complete, F.lit(False))
    return parsed.withColumn("reason", F.when(F.col("items").isNull(), "not a JSON array").when(
        ~ok, F.format_string("expected 3 insights, got %d", F.size("items"))))


def parse_insights(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows (response_id, position, insight_type, summary) and rejects
    (response_id, reason) of ``judged_responses``."""
    judged = judged_responses(responses.select("response_id", "text"))
    good = judged.where("reason is null").select("response_id", F.posexplode("items").alias("p", "x")).select(
        "response_id", (F.col("p") + 1).alias("position"), F.col("x.insight_type").alias("insight_type"),
        F.col("x.summary").alias("summary"))
    return good, judged.where("reason is not null").select("response_id", "reason")


def response_rows(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insight rows and rejects of a response log (response_id, generated_at, text, data_snapshot).

    A day takes all three insights of its latest accepted response (ties: the largest
    response_id) and nothing of any other; earlier accepted responses are rejects with the
    reason ``superseded``.  An id is the day (yyyymmdd) followed by the position.  Responses
    without a time have no day: they are rejects.  Per day one response leaves the
    map side of the aggregation."""
    judged = judged_responses(responses).withColumn("run_date", F.to_date("generated_at")).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("run_date").isNull(), "no time")))
    found = F.struct(F.col("generated_at").cast("timestamp_ntz").alias("generated_at"), "response_id", "items", "data_snapshot")
    best = judged.where("reason is null").groupBy("run_date").agg(F.max(found).alias("r"))
    day = F.date_format("run_date", "yyyyMMdd").cast("long") * 1000
    rows = best.select("run_date", "r.*").select("*", F.posexplode("items").alias("p", "x")).select(
        (day + F.col("p") + 1).alias("id"), "generated_at", F.col("x.insight_type").alias("insight_type"),
        F.col("x.summary").alias("summary"), "data_snapshot", "run_date")
    taken = best.select(F.col("run_date").alias("_day"), F.col("r.response_id").alias("_taken"))
    left = judged.join(taken, F.col("run_date") == F.col("_day"), "left").withColumn("reason", F.coalesce(
        "reason", F.when(~F.col("response_id").eqNullSafe(F.col("_taken")), "superseded")))
    return rows, left.where("reason is not null").select("response_id", "generated_at", "reason", "run_date")


def append_insights(existing: DataFrame, new: DataFrame, snapshot_text: DataFrame,
                    generated_at) -> DataFrame:
    """Rows to append: ids continue after the largest existing id in position
    order, one shared timestamp, the whole snapshot JSON on every row."""
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    snap = snapshot_text.select("data_snapshot").scalar()
    return new.select((start + F.col("position")).cast("long").alias("id"),
                      generated_at.cast("timestamp_ntz").alias("generated_at"),
                      "insight_type", "summary", snap.alias("data_snapshot"))
