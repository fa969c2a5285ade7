"""Plan checks: no cartesian products or nested-loop joins, filters and
projections reach the parquet scan, the fact table is never broadcast."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_no_cartesian_or_nested_loop(spark, name):
    from __spark_entry__ import queries
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_pruning_and_pushdown(spark):
    from __spark_entry__ import queries
    df = queries()["open_pipeline_value"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().simpleString())
    plan = df._jdf.queryExecution().simpleString()
    assert "orders.parquet" in plan
    # only the order columns the deal view needs are read
    assert all("o_clerk" not in s for s in scans)
    assert "PushedFilters" in plan or "PushedFilters" in text


def _broadcast_subtrees(plan: str) -> list[str]:
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            indent = line.index("BroadcastExchange")
            sub = [line]
            for nxt in lines[i + 1:]:
                body = nxt.lstrip(" :+-")
                if len(nxt) - len(body) <= indent:
                    break
                sub.append(nxt)
            out.append("\n".join(sub))
    return out


def test_only_bounded_sides_are_broadcast(spark):
    """With automatic broadcasting off (as for large inputs), the only broadcasts
    left are the explicit ones, and none of them carries the fact table."""
    from __spark_entry__ import queries
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ["active_deals", "deal_features", "event_mix", "dq_engagement", "deal_risk_table",
                     "mrr_timeseries", "topk_cosine", "rank_deals"]:
            df = queries()[name](spark, SF)
            plan = df._jdf.queryExecution().executedPlan().toString()
            for sub in _broadcast_subtrees(plan):
                assert "lineitem" not in sub, name
                bounded = any(m in sub for m in ("keys=[]", "GlobalLimit", "TakeOrdered", "Generate"))
                assert "orders.parquet" not in sub or bounded, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketed_deal_join_needs_no_shuffle(spark):
    from __spark_entry__ import queries
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()["active_deals_bucketed"](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        assert not re.search(r"Exchange hashpartitioning\(deal_id", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_exact_auc_on_raw_scores_has_no_window_over_scores(spark):
    """Raw scores: distinct scores are range-partitioned; the only window runs
    over the per-partition totals (one row per partition)."""
    from pyspark.sql import functions as F

    from dealgrid.operators import ml
    df = spark.range(5000).select((F.rand(3)).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    auc = ml.auc_rank_sum(df, places=None)
    auc.collect()
    plan = auc._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_s" in plan
    specs = re.findall(r"windowspecdefinition\(([^,]*)", plan)
    assert specs and all("_p" in s for s in specs)


def _scans(df, table):
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", _plan(df)))


def test_reports_read_their_tables_once(spark):
    from __spark_entry__ import queries
    q = queries()
    assert _scans(q["event_mix"](spark, SF), "lineitem") == 1
    assert _scans(q["class_balance_leads"](spark, SF), "orders") == 1
    once = _scans(q["rule_insights"](spark, SF), "orders")
    assert _scans(q["parse_insights"](spark, SF), "orders") == once
    assert _scans(q["dataset_summary"](spark, SF), "lineitem") == 1
    assert "TakeOrderedAndProject" in _plan(q["top10_leads"](spark, SF))


def test_lead_codes_need_no_shuffle_of_leads(spark):
    from __spark_entry__ import queries
    assert "Exchange hashpartitioning(source" not in _plan(queries()["lead_features"](spark, SF))


def test_hot_deal_is_split_in_the_quarantine(spark):
    """Two thirds of the events on one deal, broadcasting off: AQE splits its partition."""
    import datetime as dt

    from pyspark.sql import functions as F

    from dealgrid.operators import quality as dq
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        day = F.lit(dt.date(2024, 1, 1))
        n = 400_000
        deals = spark.range(500).select(F.concat(F.lit("D"), "id").alias("deal_id"), day.alias("created_at"),
                                        day.alias("last_contact_date"), day.alias("close_date"))
        events = spark.range(0, n, 1, 8).select(
            F.concat(F.lit("E"), "id").alias("event_id"),
            F.when(F.col("id") % 3 < 2, "D7").otherwise(F.concat(F.lit("D"), F.col("id") % 500)).alias("deal_id"),
            F.lit("call").alias("event_type"), F.lit("phone").alias("channel"), F.date_add(day, 1).alias("timestamp"))
        out = dq._with_deal_window(events, deals)
        assert out.agg(F.count("_deal_found")).first()[0] == n
        df = out.select("event_id", "_start")
        df.collect()
        assert "skew=true" in _plan(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
