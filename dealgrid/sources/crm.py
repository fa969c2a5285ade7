"""CRM tables derived from the given TPC-H-style tables.

The mapping is integer arithmetic only, so the same rows can be rebuilt by an
independent SQL engine (see ``dealgrid.plans.oracle``).  ``k`` is the order key:
one lead per order, one deal per converted lead, one event per line item of a
deal's order, one customer per won deal.

All views are lazy DataFrames.  Dimension joins (customer, supplier, nation,
region) are left to the planner: AQE broadcasts them at runtime when their
measured size is under the broadcast threshold and shuffles otherwise, so no
side is broadcast on faith.  ``lineitem`` is the fact table; it is never
broadcast and meets the deals on the order key (AQE splits a hot key).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrid.schemas import OPEN_STAGES, PRODUCTS
from dealgrid.sources.tables import Tables


def _case(expr: Column, mapping: list[tuple[object, str]], default: str | None = None) -> Column:
    out = None
    for key, val in mapping:
        cond = expr == F.lit(key)
        out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return out.otherwise(F.lit(default)) if default is not None else out


def _pick(idx: Column, values: list[str]) -> Column:
    """values[idx] for a 0-based integer column."""
    return _case(idx, list(enumerate(values)))


# Mapping of the given tables onto the CRM model (test-data convention).
PRIORITY_SOURCE = [("1", "referral"), ("2", "event"), ("3", "organic"), ("4", "outbound"),
                   ("5", "paid_search")]
SEGMENT_INDUSTRY = [("AUTOMOBILE", "pharma"), ("BUILDING", "biotech"),
                    ("FURNITURE", "medical_devices"), ("HOUSEHOLD", "cro"),
                    ("MACHINERY", "research_university")]
CONVERSION_CUT = [("referral", 80), ("event", 70), ("organic", 50), ("outbound", 40),
                  ("paid_search", 30)]
STATUS_OUTCOME = [("F", "closed_won"), ("P", "closed_lost"), ("O", "open")]
CHURN_CUT = [("starter", 45), ("growth", 25), ("enterprise", 15)]
EVENT_TYPE_BY_MOD = ["email_sent"] * 4 + ["email_reply"] * 2 + ["call"] * 2 + ["meeting"] * 2
CHURN_REASON_BY_MOD = ["price", "product_fit", "competition", "went_dark"]


def _lead_base(t: Tables) -> DataFrame:
    o = t.orders.select(
        F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("date").alias("created_at"), "o_orderpriority")
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k = F.col("k")
    source = _case(F.substring("o_orderpriority", 1, 1), PRIORITY_SOURCE)
    size_mod = F.pmod(F.col("c_custkey"), F.lit(10))
    company_size = (F.when(size_mod < 2, "1-10").when(size_mod < 5, "11-50")
                    .when(size_mod < 8, "51-200").otherwise("201-1000"))
    j = j.select(
        "k", "c_name", "o_orderstatus", "created_at", "o_totalprice",
        source.alias("source"), company_size.alias("company_size"),
        _case(F.col("c_mktsegment"), SEGMENT_INDUSTRY).alias("industry"))
    converted = F.pmod(k * 37, F.lit(100)) < _case(F.col("source"), CONVERSION_CUT)
    return j.withColumn("converted", converted)


def _leads(base: DataFrame) -> DataFrame:
    k = F.col("k")
    conv = F.col("converted")
    return base.select(
        F.concat(F.lit("LEAD"), k.cast("string")).alias("lead_id"),
        "source", "created_at", "company_size", "industry", "converted",
        F.when(conv, F.date_add("created_at", (7 + F.pmod(k, F.lit(53))).cast("int")))
        .alias("converted_at"),
        F.when(conv, F.floor("o_totalprice").cast("int")).alias("conversion_value"),
        "k", "c_name", "o_orderstatus")


def _deals(leads_k: DataFrame, t: Tables) -> DataFrame:
    n_reps = t.supplier.agg(F.count(F.lit(1))).scalar()
    k = F.col("k")
    outcome = _case(F.col("o_orderstatus"), STATUS_OUTCOME)
    created = F.col("converted_at")
    closed = outcome != F.lit("open")
    d = leads_k.where("converted").select(
        F.concat(F.lit("DEAL"), k.cast("string")).alias("deal_id"),
        "lead_id",
        F.concat(F.lit("REP"), F.pmod(k, n_reps).cast("string")).alias("rep_id"),
        _pick(F.pmod(k, F.lit(5)), PRODUCTS).alias("product"),
        F.when(closed, outcome).otherwise(_pick(F.pmod(k, F.lit(4)), OPEN_STAGES)).alias("stage"),
        created.alias("created_at"),
        F.date_add(created, F.pmod(k * 13, 7 + F.pmod(k, F.lit(84))).cast("int"))
        .alias("last_contact_date"),
        F.when(closed, F.date_add(created, (7 + F.pmod(k, F.lit(84))).cast("int")))
        .alias("close_date"),
        F.col("conversion_value").alias("value"),
        outcome.alias("outcome"),
        "k", "c_name", "company_size")
    return d


def _engagement(deals_k: DataFrame, t: Tables, raw: bool) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    d = deals_k.select("k", "deal_id", "created_at", "close_date", "last_contact_date")
    j = li.join(d, li.l_orderkey == d.k, "inner")
    etype = _pick(F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(10)), EVENT_TYPE_BY_MOD)
    if raw:
        ts = F.col("l_shipdate").cast("date")
    else:
        span = 1 + F.datediff(F.coalesce("close_date", "last_contact_date"), F.col("created_at"))
        ts = F.date_add("created_at", F.pmod(F.col("l_partkey"), span).cast("int"))
    channel = (F.when(etype.isin("email_sent", "email_reply"), "email")
               .when(etype == "call", "phone")
               .when(F.pmod(F.col("l_partkey"), F.lit(4)) == 0, "in_person")
               .otherwise("zoom"))
    return j.select(
        F.concat_ws("-", F.concat(F.lit("EVT"), F.col("l_orderkey").cast("string")),
                    F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
        .alias("event_id"),
        "deal_id", etype.alias("event_type"), ts.alias("timestamp"), channel.alias("channel"))


def _customers(deals_k: DataFrame) -> DataFrame:
    k = F.col("k")
    tier = (F.when(F.col("company_size").isin("1-10", "11-50"), "starter")
            .when(F.col("company_size") == "51-200", "growth").otherwise("enterprise"))
    mrr = (F.when(tier == "starter", 1800 + F.pmod(k, F.lit(701)))
           .when(tier == "growth", 5000 + F.pmod(k, F.lit(2501)))
           .otherwise(12000 + F.pmod(k, F.lit(6001))))
    churned = F.pmod(k * 17, F.lit(100)) < _case(tier, CHURN_CUT)
    return deals_k.where(F.col("outcome") == "closed_won").select(
        F.concat(F.lit("CUST"), k.cast("string")).alias("customer_id"),
        F.col("c_name").alias("company_name"),
        tier.alias("subscription_tier"),
        mrr.cast("int").alias("mrr"),
        F.col("close_date").alias("start_date"),
        F.when(churned, F.add_months("close_date", (1 + F.pmod(k, F.lit(36))).cast("int")))
        .alias("churn_date"),
        F.when(churned, _pick(F.pmod(k, F.lit(4)), CHURN_REASON_BY_MOD)).alias("churn_reason"))


def _reps(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    key = F.col("s_suppkey")
    return j.select(
        F.concat(F.lit("REP"), key.cast("string")).alias("rep_id"),
        F.col("s_name").alias("name"),
        F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(key * 37, F.lit(1460)).cast("int"))
        .alias("hire_date"),
        F.col("r_name").alias("territory"),
        (800000 + F.pmod(key * 7919, F.lit(700000))).cast("int").alias("annual_quota"))


# Test-data convention: event type of the given `events` table -> insight type
# of the `insights` table
EVENT_INSIGHT_TYPE = [("view", "mrr"), ("click", "churn"), ("purchase", "pipeline"),
                      ("signup", "leads"), ("error", "deals")]


def _insights(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id").cast("long").alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("generated_at"),
        _case(F.col("event_type"), EVENT_INSIGHT_TYPE).alias("insight_type"),
        F.col("props").alias("summary"),
        F.col("props").alias("data_snapshot"))


class CRM:
    """The CRM tables as lazy DataFrames: each view is defined on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.tables = Tables(spark, sf_dir)
        self.extra = {"tables": self.tables}

    @cached_property
    def _leads_k(self) -> DataFrame:
        return _leads(_lead_base(self.tables))

    @cached_property
    def _deals_k(self) -> DataFrame:
        return _deals(self._leads_k, self.tables)

    @cached_property
    def reps(self) -> DataFrame:
        return _reps(self.tables)

    @cached_property
    def leads(self) -> DataFrame:
        return self._leads_k.select(*LEAD_COLS)

    @cached_property
    def deals(self) -> DataFrame:
        return self._deals_k.select(*DEAL_COLS)

    @cached_property
    def engagement(self) -> DataFrame:
        return _engagement(self._deals_k, self.tables, raw=False)

    @cached_property
    def engagement_raw(self) -> DataFrame:
        return _engagement(self._deals_k, self.tables, raw=True)

    @cached_property
    def customers(self) -> DataFrame:
        return _customers(self._deals_k)

    @cached_property
    def insights(self) -> DataFrame:
        return _insights(self.tables)

    def as_dict(self) -> dict[str, DataFrame]:
        return {"reps": self.reps, "leads": self.leads, "deals": self.deals,
                "engagement": self.engagement, "customers": self.customers}


LEAD_COLS = ["lead_id", "source", "created_at", "company_size", "industry", "converted",
             "converted_at", "conversion_value"]
DEAL_COLS = ["deal_id", "lead_id", "rep_id", "product", "stage", "created_at",
             "last_contact_date", "close_date", "value", "outcome"]


def build_crm(spark: SparkSession, sf_dir: str) -> CRM:
    return CRM(spark, sf_dir)
