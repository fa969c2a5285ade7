"""Data-quality checks (validators, constraints) as one-pass aggregations.

Each table is scanned once: every check is a ``count_if`` column of a single
aggregation, unpivoted with ``stack`` into ``(table_name, check_name, bad_rows)``.
Keys are reduced before they meet another table: deal windows and parent keys
are aggregated to one row per key (so a repeated parent key cannot multiply
child rows), events are counted per (deal, day) before the window check, and
child rows are counted per key before the anti joins of the FK checks -- a key
holding a large share of the rows is combined map-side.  ``quarantine`` gives
the failing rows themselves with the names of the checks they fail.

NULL rules: a NULL in an enum column is invalid; a NULL date in a comparison is
not a violation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.core import count_if, enum_invalid
from dealgrid.schemas import (CHANNELS, COMPANY_SIZES, DEAL_STAGES, EVENT_TYPES, LEAD_SOURCES,
                              OUTCOMES, PRIMARY_KEYS, REQUIRED_FIELDS, TIERS)
from dealgrid.session import scratch_path

# FIXED VALUES: issue message formats, by check, in validator order
MESSAGES = {
    ("leads", "bad_conversion_value"):
        "{n} converted rows have missing or non-positive conversion_value",
    ("leads", "converted_before_created"): "{n} rows where converted_at < created_at",
    ("leads", "created_in_future"): "{n} rows with created_at in the future",
    ("leads", "invalid_source"): "{n} rows with invalid source values",
    ("leads", "invalid_company_size"): "{n} rows with invalid company_size values",
    ("deals", "contact_before_created"): "{n} rows where last_contact_date < created_at",
    ("deals", "close_before_created"): "{n} rows where close_date < created_at",
    ("deals", "invalid_stage"): "{n} rows with invalid stage values",
    ("deals", "invalid_outcome"): "{n} rows with invalid outcome values",
    ("deals", "missing_lead"): "{n} rows reference non-existent lead_id",
    ("engagement", "missing_deal"): "{n} rows reference non-existent deal_id",
    ("engagement", "before_deal_start"): "{n} events before deal created_at",
    ("engagement", "after_deal_end"): "{n} events after deal end date",
    ("engagement", "invalid_event_type"): "{n} rows with invalid event_type",
    ("engagement", "invalid_channel"): "{n} rows with invalid channel",
    ("customers", "non_positive_mrr"): "{n} rows with non-positive MRR",
    ("customers", "churn_not_after_start"): "{n} rows where churn_date <= start_date",
    ("customers", "churn_without_reason"): "{n} churned rows missing churn_reason",
    ("customers", "invalid_tier"): "{n} rows with invalid subscription_tier",
}
CHECK_ORDER = {key: i for i, key in enumerate(MESSAGES)}


def _unpivot(table: str, agg: DataFrame, checks: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in checks)
    return agg.selectExpr(f"stack({len(checks)}, {pairs}) AS (check_name, bad_rows)").select(
        F.lit(table).alias("table_name"), "check_name", F.col("bad_rows").cast("long"))


# -- row flags ---------------------------------------------------------------

def lead_flags(as_of: dt.date) -> dict[str, Column]:
    conv = F.col("converted") == F.lit(True)
    v = F.col("conversion_value")
    return {
        "bad_conversion_value": conv & (v.isNull() | (v <= 0)),
        "converted_before_created": F.col("converted_at") < F.col("created_at"),
        "created_in_future": F.col("created_at") > F.lit(as_of),
        "invalid_source": enum_invalid("source", LEAD_SOURCES),
        "invalid_company_size": enum_invalid("company_size", COMPANY_SIZES),
    }


def deal_flags() -> dict[str, Column]:
    return {
        "contact_before_created": F.col("last_contact_date") < F.col("created_at"),
        "close_before_created": F.col("close_date") < F.col("created_at"),
        "invalid_stage": enum_invalid("stage", DEAL_STAGES),
        "invalid_outcome": enum_invalid("outcome", OUTCOMES),
        "missing_lead": F.col("_lead_found").isNull(),
    }


def event_flags() -> dict[str, Column]:
    ts = F.col("timestamp")
    return {
        "missing_deal": F.col("_deal_found").isNull(),
        "before_deal_start": ts < F.col("_start"),
        "after_deal_end": ts > F.col("_end"),
        "invalid_event_type": enum_invalid("event_type", EVENT_TYPES),
        "invalid_channel": enum_invalid("channel", CHANNELS),
    }


def customer_flags() -> dict[str, Column]:
    churn = F.col("churn_date")
    return {
        "non_positive_mrr": F.col("mrr") <= 0,
        "churn_not_after_start": churn <= F.col("start_date"),
        "churn_without_reason": churn.isNotNull() & F.col("churn_reason").isNull(),
        "invalid_tier": enum_invalid("subscription_tier", TIERS),
    }


def _count_flags(table: str, df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    agg = df.agg(*[count_if(c).alias(n) for n, c in flags.items()])
    return _unpivot(table, agg, list(flags))


def _with_lead_found(deals: DataFrame, leads: DataFrame) -> DataFrame:
    keys = leads.select(F.col("lead_id").alias("_lid")).distinct().withColumn("_lead_found", F.lit(1))
    return deals.join(keys, deals.lead_id == keys._lid, "left")


def _deal_windows(deals: DataFrame) -> DataFrame:
    # One row per deal key (duplicated deal ids must not multiply events): the
    # earliest start and the latest end of the key's rows.
    return deals.groupBy(F.col("deal_id").alias("_did")).agg(
        F.lit(1).alias("_deal_found"),
        F.min("created_at").alias("_start"),
        F.max(F.coalesce("close_date", "last_contact_date")).alias("_end"))


def _event_counts(events: DataFrame, win: DataFrame) -> DataFrame:
    """Events counted per (deal, day) with their enum flags first -- combined
    map-side, so a deal holding a large share of all events reaches the join as
    one row per active day -- then matched to the deal windows; the check
    counts are sums of the per-day counts."""
    per_day = events.groupBy("deal_id", "timestamp").agg(
        F.count(F.lit(1)).alias("_rows"),
        count_if(enum_invalid("event_type", EVENT_TYPES)).alias("_bad_type"),
        count_if(enum_invalid("channel", CHANNELS)).alias("_bad_channel"))
    j = per_day.join(win, per_day.deal_id == win._did, "left")
    ts = F.col("timestamp")
    n = F.col("_rows")

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0)).cast("long")
    agg = j.agg(total(F.col("_deal_found").isNull()).alias("missing_deal"),
                total(ts < F.col("_start")).alias("before_deal_start"),
                total(ts > F.col("_end")).alias("after_deal_end"),
                F.sum("_bad_type").cast("long").alias("invalid_event_type"),
                F.sum("_bad_channel").cast("long").alias("invalid_channel"))
    return _unpivot("engagement", agg, ["missing_deal", "before_deal_start", "after_deal_end",
                                        "invalid_event_type", "invalid_channel"])


def _with_deal_window(events: DataFrame, deals: DataFrame) -> DataFrame:
    """Row-level: every event with its deal's window (for quarantine).  The windows
    (one row per deal) are written first: both join sides then are plain shuffles,
    which AQE can split when a deal holds a large share of the events."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "deal-windows")
    win = _deal_windows(deals)
    win.write.parquet(path)
    win = spark.read.schema(win.schema).parquet(path)
    return events.join(win, events.deal_id == win._did, "left")


# -- validators ----------------------------------------------------------------

def validate_leads(leads: DataFrame, as_of: dt.date) -> DataFrame:
    return _count_flags("leads", leads, lead_flags(as_of))


def validate_deals(deals: DataFrame, leads: DataFrame) -> DataFrame:
    return _count_flags("deals", _with_lead_found(deals, leads), deal_flags())


def validate_engagement(events: DataFrame, deals: DataFrame) -> DataFrame:
    return _event_counts(events, _deal_windows(deals))


def validate_customers(customers: DataFrame) -> DataFrame:
    return _count_flags("customers", customers, customer_flags())


def check_counts(t: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """All checks of all tables, zero counts included: (table_name, check_name, bad_rows)."""
    return (validate_leads(t["leads"], as_of)
            .unionByName(validate_deals(t["deals"], t["leads"]))
            .unionByName(validate_engagement(t["engagement"], t["deals"]))
            .unionByName(validate_customers(t["customers"])))


def _message(counts: DataFrame) -> DataFrame:
    fmt = None
    order = None
    for (table, check), text in MESSAGES.items():
        cond = (F.col("table_name") == table) & (F.col("check_name") == check)
        msg = F.format_string(f"{table}: {text.replace('{n}', '%d')}", F.col("bad_rows"))
        fmt = F.when(cond, msg) if fmt is None else fmt.when(cond, msg)
        pos = F.lit(CHECK_ORDER[(table, check)])
        order = F.when(cond, pos) if order is None else order.when(cond, pos)
    return counts.withColumn("message", fmt).withColumn("check_order", order.cast("int"))


def validate_all(t: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """Issues only (bad_rows > 0), one message line each, in validator order."""
    return (_message(check_counts(t, as_of)).where(F.col("bad_rows") > 0)
            .select("table_name", "check_name", "bad_rows", "message", "check_order"))


def _failed(flags: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())


def quarantine(t: dict[str, DataFrame], as_of: dt.date) -> dict[str, DataFrame]:
    """Row-level results: every row that fails at least one check, with the
    names of the checks it fails (``failed_checks``), per table."""
    deals = _with_lead_found(t["deals"], t["leads"])
    events = _with_deal_window(t["engagement"], t["deals"])
    out = {
        "leads": t["leads"].withColumn("failed_checks", _failed(lead_flags(as_of))),
        "deals": deals.withColumn("failed_checks", _failed(deal_flags()))
                      .drop("_lid", "_lead_found"),
        "engagement": events.withColumn("failed_checks", _failed(event_flags()))
                            .drop("_did", "_deal_found", "_start", "_end"),
        "customers": t["customers"].withColumn("failed_checks", _failed(customer_flags())),
    }
    return {k: v.where(F.size("failed_checks") > 0) for k, v in out.items()}


def dq_report_totals(issues: DataFrame) -> DataFrame:
    """Issue count and bad-row count per table plus a grand total (table_name NULL)."""
    return issues.rollup("table_name").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("bad_rows").cast("long").alias("bad_rows"))


# -- constraints ---------------------------------------------------------------

def required_fields(t: dict[str, DataFrame]) -> DataFrame:
    """Null count of every required column: (table_name, column_name, null_rows)."""
    out = None
    for table, cols in REQUIRED_FIELDS.items():
        agg = t[table].agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols])
        pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
        part = agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, null_rows)").select(
            F.lit(table).alias("table_name"), "column_name", F.col("null_rows").cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def assert_required(name: str, df: DataFrame) -> None:
    """Raise when a required column of table ``name`` holds NULLs (one pass)."""
    cols = REQUIRED_FIELDS[name]
    row = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise ValueError(f"{name}: nulls found in required fields: {bad}")


def unique_keys(t: dict[str, DataFrame]) -> DataFrame:
    """Keys that must be unique: (table_name, key_column, duplicate_keys, surplus_rows)."""
    keys = list(PRIMARY_KEYS.items()) + [("deals", "lead_id")]
    out = None
    for table, col in keys:
        dup = t[table].groupBy(col).count().where(F.col("count") > 1)
        part = dup.agg(F.count(F.lit(1)).cast("long").alias("duplicate_keys"),
                       F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long")
                       .alias("surplus_rows")).select(
            F.lit(table).alias("table_name"), F.lit(col).alias("key_column"),
            "duplicate_keys", "surplus_rows")
        out = part if out is None else out.unionByName(part)
    return out


FOREIGN_KEYS = [("deals", "lead_id", "leads", "lead_id"), ("deals", "rep_id", "reps", "rep_id"),
                ("engagement", "deal_id", "deals", "deal_id")]


def foreign_keys(t: dict[str, DataFrame]) -> DataFrame:
    """Orphans of every declared foreign key: (table_name, column_name, ref_table, orphan_rows)."""
    out = None
    for table, col, ref, ref_col in FOREIGN_KEYS:
        # child rows are counted per key first (combined map-side), so a key
        # holding a large share of the rows reaches the anti join as one row
        child = t[table].groupBy(F.col(col).alias("_c")).agg(F.count(F.lit(1)).alias("_rows"))
        parent = t[ref].select(F.col(ref_col).alias("_k")).distinct()
        orphans = child.join(parent, F.col("_c") == F.col("_k"), "left_anti")
        part = orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("orphan_rows")).select(
            F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
            F.lit(ref).alias("ref_table"), "orphan_rows")
        out = part if out is None else out.unionByName(part)
    return out


def feature_checks(features: DataFrame, table: str, feature_cols: list[str],
                   target: str) -> DataFrame:
    """Feature-table gate: required columns present (checked on the schema), no NULL
    in any feature or the target, target in {0, 1}: (table_name, check_name, bad_rows)."""
    missing = [c for c in feature_cols + [target] if c not in features.columns]
    if missing:
        raise ValueError(f"Missing expected feature columns: {missing}")
    flags = {f"null_{c}": F.col(c).isNull() for c in feature_cols + [target]}
    flags["target_not_binary"] = F.coalesce(~F.col(target).isin(0, 1), F.lit(False))
    return _count_flags(table, features, flags)
