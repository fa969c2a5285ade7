"""Validators: a clean micro-frame gives no issue; one bad row gives exactly one."""

import datetime as dt

from pyspark.sql import functions as F

from dealgrid.operators import quality as dq
from pyspark.sql import types as T

from dealgrid.schemas import CUSTOMERS, DEALS, ENGAGEMENT, LEADS


def _nullable(schema):
    """Micro-frames must be able to hold the bad values the checks look for."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


LEADS, DEALS, ENGAGEMENT, CUSTOMERS = map(_nullable, (LEADS, DEALS, ENGAGEMENT, CUSTOMERS))

D = dt.date
TODAY = D(2024, 6, 1)


def _leads(spark, rows=None):
    base = [("L1", "referral", D(2024, 1, 1), "1-10", "pharma", True, D(2024, 1, 10), 100),
            ("L2", "event", D(2024, 1, 2), "11-50", "cro", False, None, None)]
    return spark.createDataFrame(rows or base, LEADS)


def _deals(spark, rows=None):
    base = [("D1", "L1", "R1", "p", "discovery", D(2024, 1, 10), D(2024, 2, 1), None, 100, "open"),
            ("D2", "L2", "R1", "p", "closed_won", D(2024, 1, 10), D(2024, 2, 1), D(2024, 2, 5), 5, "closed_won")]
    return spark.createDataFrame(rows or base, DEALS)


def _counts(df):
    return {r["check_name"]: r["bad_rows"] for r in df.collect()}


def test_clean_frames_have_no_issue(spark):
    leads, deals = _leads(spark), _deals(spark)
    ev = spark.createDataFrame([("E1", "D1", "call", D(2024, 1, 15), "phone")], ENGAGEMENT)
    cust = spark.createDataFrame([("C1", "X", "starter", 10, D(2024, 1, 1), D(2024, 3, 1), "price")], CUSTOMERS)
    t = {"leads": leads, "deals": deals, "engagement": ev, "customers": cust}
    assert dq.validate_all(t, TODAY).count() == 0
    assert all(v == 0 for v in _counts(dq.check_counts(t, TODAY)).values())


def test_deal_contact_before_created_is_caught(spark):
    # the reference's own unit test: one corrupted row among three
    rows = [(f"D{i}", f"L{i}", "R1", "p", "discovery", TODAY - dt.timedelta(days=30),
             TODAY - dt.timedelta(days=5), None, 1, "open") for i in (1, 2, 3)]
    rows[0] = rows[0][:6] + (rows[0][5] - dt.timedelta(days=1),) + rows[0][7:]
    leads = _leads(spark, [(f"L{i}", "organic", D(2024, 1, 1), "1-10", "pharma", False, None, None)
                           for i in (1, 2, 3)])
    out = dq.validate_all({"leads": leads, "deals": spark.createDataFrame(rows, DEALS),
                           "engagement": spark.createDataFrame([], ENGAGEMENT),
                           "customers": spark.createDataFrame([], CUSTOMERS)}, TODAY).collect()
    msgs = [r["message"] for r in out]
    assert msgs == ["deals: 1 rows where last_contact_date < created_at"]


def test_lead_checks_one_bad_row_each(spark):
    rows = [
        ("A", "referral", D(2024, 1, 1), "1-10", "x", True, D(2024, 1, 5), None),      # null value
        ("B", "referral", D(2024, 1, 1), "1-10", "x", True, D(2024, 1, 5), 0),         # zero value
        ("C", "referral", D(2024, 1, 5), "1-10", "x", True, D(2024, 1, 1), 5),         # converted before
        ("D", "referral", D(2030, 1, 1), "1-10", "x", False, None, None),             # future
        ("E", None, D(2024, 1, 1), "1-10", "x", False, None, None),                   # NULL enum
        ("F", "referral", D(2024, 1, 1), "huge", "x", False, None, None),             # bad size
    ]
    schema = LEADS
    c = _counts(dq.validate_leads(spark.createDataFrame(rows, schema), TODAY))
    assert c == {"bad_conversion_value": 2, "converted_before_created": 1, "created_in_future": 1,
                 "invalid_source": 1, "invalid_company_size": 1}


def test_deal_checks_and_fk(spark):
    rows = [("D1", "L1", "R1", "p", "bogus", D(2024, 1, 10), D(2024, 2, 1), D(2024, 1, 1), 1, "open"),
            ("D2", "LX", "R1", "p", "closed_won", D(2024, 1, 10), D(2024, 2, 1), None, 1, "maybe")]
    c = _counts(dq.validate_deals(spark.createDataFrame(rows, DEALS), _leads(spark)))
    assert c == {"contact_before_created": 0, "close_before_created": 1, "invalid_stage": 1,
                 "invalid_outcome": 1, "missing_lead": 1}


def test_event_window_and_orphans(spark):
    deals = _deals(spark)
    ev = spark.createDataFrame([
        ("E1", "D1", "call", D(2024, 1, 1), "phone"),        # before start
        ("E2", "D2", "meeting", D(2024, 3, 1), "zoom"),      # after close
        ("E3", "D1", "call", D(2024, 2, 2), "phone"),        # after last contact (open deal)
        ("E4", "DX", "fax", D(2024, 1, 1), "pigeon"),        # orphan: bounds NULL -> not counted
        ("E5", "D1", None, D(2024, 1, 20), None),            # NULL enums
    ], ENGAGEMENT)
    c = _counts(dq.validate_engagement(ev, deals))
    assert c == {"missing_deal": 1, "before_deal_start": 1, "after_deal_end": 2,
                 "invalid_event_type": 2, "invalid_channel": 2}


def test_duplicate_deal_ids_do_not_multiply_events(spark):
    deals = _deals(spark).unionByName(_deals(spark))
    ev = spark.createDataFrame([("E1", "D1", "call", D(2024, 1, 1), "phone")], ENGAGEMENT)
    assert _counts(dq.validate_engagement(ev, deals))["before_deal_start"] == 1


def test_customer_checks(spark):
    rows = [("C1", "X", "starter", 0, D(2024, 1, 1), None, None),
            ("C2", "X", "gold", 5, D(2024, 1, 1), D(2024, 1, 1), None),          # churn = start
            ("C3", "X", "growth", 5, D(2024, 1, 1), D(2024, 5, 1), None)]
    c = _counts(dq.validate_customers(spark.createDataFrame(rows, CUSTOMERS)))
    assert c == {"non_positive_mrr": 1, "churn_not_after_start": 1, "churn_without_reason": 2,
                 "invalid_tier": 1}


def test_foreign_keys_include_rep(spark):
    t = {"leads": _leads(spark), "deals": _deals(spark),
         "reps": spark.createDataFrame([("R2",)], "rep_id string"),
         "engagement": spark.createDataFrame([], ENGAGEMENT)}
    out = {r["column_name"]: r["orphan_rows"] for r in dq.foreign_keys(t).collect()}
    assert out == {"lead_id": 0, "rep_id": 2, "deal_id": 0}


def test_unique_keys_and_required(spark, crm):
    uk = dq.unique_keys(crm.as_dict()).where(F.col("table_name") == "deals").first()
    assert uk["duplicate_keys"] == 0
    twice = {**crm.as_dict(), "deals": crm.deals.unionByName(crm.deals.limit(3))}
    assert dq.unique_keys(twice).where(F.col("table_name") == "deals").first()["duplicate_keys"] == 3
    req = dq.required_fields(crm.as_dict()).where(F.col("null_rows") > 0).count()
    assert req == 0


def test_assert_required_raises(spark):
    import pytest
    ok = _leads(spark)
    dq.assert_required("leads", ok)
    bad = spark.createDataFrame([("L9", None, D(2024, 1, 1), "1-10", "x", False, None, None)], LEADS)
    with pytest.raises(ValueError, match="source"):
        dq.assert_required("leads", bad)
