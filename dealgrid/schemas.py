"""CRM data model: table schemas and value domains.

FIXED VALUES — these must equal the application's own domain lists and rule
constants for results to agree; they are stated here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: value domains checked by the validators
# ---------------------------------------------------------------------------
LEAD_SOURCES = ["paid_search", "organic", "referral", "outbound", "event"]
COMPANY_SIZES = ["1-10", "11-50", "51-200", "201-1000"]
DEAL_STAGES = ["prospecting", "discovery", "proposal", "negotiation", "closed_won", "closed_lost"]
OPEN_STAGES = ["prospecting", "discovery", "proposal", "negotiation"]
OUTCOMES = ["closed_won", "closed_lost", "open"]
EVENT_TYPES = ["email_sent", "email_reply", "call", "meeting"]
CHANNELS = ["email", "phone", "zoom", "in_person"]
TIERS = ["starter", "growth", "enterprise"]
CHURN_REASONS = ["price", "product_fit", "competition", "went_dark"]
INDUSTRIES = ["pharma", "biotech", "medical_devices", "cro", "research_university",
              "hospital_system", "diagnostics"]
INSIGHT_TYPES = ["mrr", "churn", "pipeline", "leads", "deals"]
PRODUCTS = ["LIMS Software", "Lab Automation Platform", "Genomic Sequencing Tools",
            "Clinical Trial Management Software", "Reagent Supply Contract"]

# ---------------------------------------------------------------------------
# FIXED VALUES: lead conversion rule (base rate by source, multipliers by
# company size and industry, slow and peak months, cap)
SOURCE_CONVERSION_RATES = {"paid_search": 0.08, "organic": 0.14, "referral": 0.35,
                           "outbound": 0.10, "event": 0.35}
COMPANY_SIZE_MULTIPLIERS = {"1-10": 0.4, "11-50": 0.8, "51-200": 1.9, "201-1000": 1.2}
INDUSTRY_MULTIPLIERS = {"pharma": 1.3, "biotech": 1.2, "medical_devices": 1.0,
                        "diagnostics": 0.9, "hospital_system": 0.8, "cro": 0.7,
                        "research_university": 0.5}
SLOW_MONTHS = {3: 0.5, 8: 0.5}
PEAK_MONTHS = {10: 1.4, 11: 1.4}
CONVERSION_CAP = 0.95

# FIXED VALUES: deal win rule (base win rate, stale-contact penalty after 14
# days, first three reps as over-performers, cap)
BASE_WIN_RATE = 0.55
STALE_CONTACT_DAYS = 14
STALE_CONTACT_MULTIPLIER = 0.60
N_OVERPERFORMERS = 3
OVERPERFORMER_WIN_MULTIPLIER = 1.6
WIN_CAP = 0.95

# FIXED VALUES: subscription tier by company size
TIER_BY_SIZE = {"1-10": "starter", "11-50": "starter", "51-200": "growth", "201-1000": "enterprise"}

# FIXED VALUES: thresholds used by the pages and the snapshot
AT_RISK_THRESHOLD = 0.7
CRITICAL_THRESHOLD = 0.8
HIGH_PRIORITY = 0.7
MEDIUM_PRIORITY = 0.4
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
TOP_K = 5

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
REPS = T.StructType([
    T.StructField("rep_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("hire_date", T.DateType(), False),
    T.StructField("territory", T.StringType(), False),
    T.StructField("annual_quota", T.IntegerType(), False),
])
LEADS = T.StructType([
    T.StructField("lead_id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("created_at", T.DateType(), False),
    T.StructField("company_size", T.StringType(), False),
    T.StructField("industry", T.StringType(), False),
    T.StructField("converted", T.BooleanType(), False),
    T.StructField("converted_at", T.DateType(), True),
    T.StructField("conversion_value", T.IntegerType(), True),
])
DEALS = T.StructType([
    T.StructField("deal_id", T.StringType(), False),
    T.StructField("lead_id", T.StringType(), False),
    T.StructField("rep_id", T.StringType(), False),
    T.StructField("product", T.StringType(), True),
    T.StructField("stage", T.StringType(), False),
    T.StructField("created_at", T.DateType(), False),
    T.StructField("last_contact_date", T.DateType(), False),
    T.StructField("close_date", T.DateType(), True),
    T.StructField("value", T.IntegerType(), False),
    T.StructField("outcome", T.StringType(), False),
])
ENGAGEMENT = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("deal_id", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("timestamp", T.DateType(), False),
    T.StructField("channel", T.StringType(), False),
])
CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("subscription_tier", T.StringType(), False),
    T.StructField("mrr", T.IntegerType(), False),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("churn_date", T.DateType(), True),
    T.StructField("churn_reason", T.StringType(), True),
])
INSIGHTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("generated_at", T.TimestampNTZType(), False),
    T.StructField("insight_type", T.StringType(), False),
    T.StructField("summary", T.StringType(), False),
    T.StructField("data_snapshot", T.StringType(), True),
])

TABLE_SCHEMAS = {"reps": REPS, "leads": LEADS, "deals": DEALS, "engagement": ENGAGEMENT,
                 "customers": CUSTOMERS}

# Date columns per table, parsed on load (unparseable -> NULL)
DATE_COLUMNS = {
    "reps": ["hire_date"],
    "leads": ["created_at", "converted_at"],
    "deals": ["created_at", "last_contact_date", "close_date"],
    "engagement": ["timestamp"],
    "customers": ["start_date", "churn_date"],
}

# Required (NOT NULL) columns per table
REQUIRED_FIELDS = {
    "reps": ["rep_id", "name", "hire_date", "territory", "annual_quota"],
    "leads": ["lead_id", "source", "created_at", "company_size", "industry", "converted"],
    "deals": ["deal_id", "lead_id", "rep_id", "stage", "created_at", "last_contact_date",
              "value", "outcome"],
    "engagement": ["event_id", "deal_id", "event_type", "timestamp", "channel"],
    "customers": ["customer_id", "company_name", "subscription_tier", "mrr", "start_date"],
}

PRIMARY_KEYS = {"reps": "rep_id", "leads": "lead_id", "deals": "deal_id",
                "engagement": "event_id", "customers": "customer_id"}

# NOT NULL columns and foreign keys (column, parent table) enforced by a load
NOT_NULL = {**REQUIRED_FIELDS, "deals": [*REQUIRED_FIELDS["deals"], "product"]}
FOREIGN_KEYS = {"deals": [("lead_id", "leads"), ("rep_id", "reps")], "engagement": [("deal_id", "deals")]}

LEAD_FEATURE_COLS = ["source_encoded", "company_size_encoded", "industry_encoded", "lead_month"]
DEAL_FEATURE_COLS = ["days_since_last_contact", "deal_age_days", "engagement_count",
                     "meeting_count", "email_reply_rate", "deal_value"]
