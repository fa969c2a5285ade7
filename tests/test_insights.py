"""Insight parsing (code fences, counts, broken JSON), labels, formats."""

from pyspark.sql import functions as F

from dealgrid.operators import insights as ins
from dealgrid.operators.presentation import insight_label
from dealgrid.functions.core import capitalize, money, pretty_label

ITEMS = '[{"insight_type":"mrr","summary":"a"},{"insight_type":"churn","summary":"b"},' \
        '{"insight_type":"leads","summary":"c"}]'


def test_parse_variants(spark):
    texts = [(1, ITEMS), (2, "```json\n" + ITEMS + "\n```"), (3, "```\n" + ITEMS + "```"),
             (4, '[{"insight_type":"mrr","summary":"a"},{"insight_type":"deals","summary":"b"}]'),
             (5, ITEMS[:-1] + ',{"insight_type":"deals","summary":"d"}]'),
             (6, '[{"insight_type":"mrr"'), (7, "no json here"),
             (8, '[{"insight_type":"mrr"},{"insight_type":"churn","summary":"b"},{"summary":"c"}]'),
             (9, "\n\t```json\n" + ITEMS + "\n```\n")]
    good, bad = ins.parse_insights(spark.createDataFrame(texts, "response_id int, text string"))
    assert sorted({r["response_id"] for r in good.collect()}) == [1, 2, 3, 9]
    reasons = {r["response_id"]: r["reason"] for r in bad.collect()}
    assert reasons[4] == "expected 3 insights, got 2"
    assert reasons[5] == "expected 3 insights, got 4"
    assert reasons[6] == reasons[7] == "not a JSON array"
    assert 8 in reasons
    first = good.where("response_id = 2").orderBy("position").first()
    assert (first["position"], first["insight_type"], first["summary"]) == (1, "mrr", "a")


def test_labels(spark):
    df = spark.createDataFrame([("mrr",), ("churn",), ("medical_devices",), ("PAID_search",)], "t string")
    rows = df.select(insight_label(F.col("t")), pretty_label("t"), capitalize("t")).collect()
    assert [r[0] for r in rows] == ["MRR", "Churn", "Medical_devices", "Paid_search"]
    assert [r[1] for r in rows] == ["Mrr", "Churn", "Medical devices", "Paid search"]


def test_money(spark):
    df = spark.createDataFrame([(1234567,), (0,)], "v int")
    assert [r[0] for r in df.select(money("v")).collect()] == ["$1,234,567", "$0"]


def test_snapshot_and_rules(spark, crm):
    from dealgrid.operators import ranking as rk
    snap = ins.snapshot(spark, crm.customers, crm.deals, crm.leads,
                        rk.deal_risk_scores(crm.deals, crm.reps))
    row = snap.first()
    assert set(row["churn_by_tier"]) == {"starter", "growth", "enterprise"}
    assert len(row["top_acquisition_channels"]) == 3
    rules = ins.rule_insights(snap).collect()
    assert 1 <= len(rules) <= 3
    assert [r["position"] for r in rules] == list(range(1, len(rules) + 1))
    js = ins.snapshot_json(snap).first()[0]
    assert js.startswith('{"mrr":{"current_month"')


def test_padded_id(spark):
    from dealgrid.functions.core import padded_id
    df = spark.createDataFrame([(1,), (42,), (123456,)], "n int")
    assert [r[0] for r in df.select(padded_id("LEAD", "n")).collect()] == ["LEAD0001", "LEAD0042", "LEAD123456"]


def test_snapshot_json_carries_every_leaf(spark, crm):
    """The JSON text (rows-only query) decodes to exactly the oracle-checked leaves."""
    import json
    import math

    from dealgrid.operators import ranking as rk
    snap = ins.snapshot(spark, crm.customers, crm.deals, crm.leads,
                        rk.deal_risk_scores(crm.deals, crm.reps))
    doc = json.loads(ins.snapshot_json(snap).first()[0])
    leaves = ins.snapshot_leaves(snap).collect()
    assert leaves
    for leaf in leaves:
        node = doc
        for part in leaf["leaf"].split("."):
            node = node[int(part)] if isinstance(node, list) else node[part]
        if leaf["text_value"] is not None:
            assert node == leaf["text_value"]
        else:
            assert math.isclose(float(node), leaf["num_value"], rel_tol=1e-12, abs_tol=1e-12)


def test_response_job_takes_one_reply_a_day_whole_or_none(spark, tmp_path):
    """The latest accepted reply of a day counts; short, broken and superseded ones are rejects;
    a repeated run changes nothing; a day without an accepted reply keeps its rows."""
    import datetime as dt

    from dealgrid.plans import jobs
    at = lambda d, h: dt.datetime(2024, 5, d, h)
    later = ITEMS.replace('"a"', '"later"')
    log = [("r1", at(1, 8), ITEMS, "{}"), ("r2", at(1, 9), "```json\n" + later + "\n```", "{}"), ("r3", at(1, 10), ITEMS[:-2], "{}"),
           ("r4", at(2, 8), "[]", "{}"), ("r5", at(2, 9), None, None), ("r6", at(3, 8), ITEMS, None),
           ("r7", None, ITEMS, "{}"), ("r8", at(2, 10), "", "{}")]
    schema = "response_id string, generated_at timestamp, text string, data_snapshot string"
    out, bad = str(tmp_path / "insights"), str(tmp_path / "rejects")
    runs = []
    for _ in range(2):
        jobs.response_insights(spark, spark.createDataFrame(log, schema).repartition(3), out, bad)
        runs.append(sorted(tuple(r) for r in spark.read.parquet(out).select("id", "insight_type", "summary").collect()))
    assert runs[0] == runs[1] == [
        (20240501001, "mrr", "later"), (20240501002, "churn", "b"), (20240501003, "leads", "c"),
        (20240503001, "mrr", "a"), (20240503002, "churn", "b"), (20240503003, "leads", "c")]
    assert {r["response_id"]: r["reason"] for r in spark.read.parquet(bad).collect()} == {
        "r1": "superseded", "r3": "not a JSON array", "r4": "expected 3 insights, got 0", "r5": "not a JSON array",
        "r7": "no time", "r8": "not a JSON array"}
    only_bad = spark.createDataFrame([("r9", at(3, 9), "[1]", "{}")], schema)
    jobs.response_insights(spark, only_bad, out, bad)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "insight_type", "summary").collect()) == runs[0]
    rows, rejects = jobs.response_insights(spark, spark.createDataFrame([], schema), out, bad)
    assert rows.count() == rejects.count() == 0
