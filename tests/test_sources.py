"""CSV and parquet sources/sinks: typed reads, lenient dates, round trips, refresh."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dealgrid.sources import files as io


def test_csv_dates_lenient(spark, tmp_path):
    p = tmp_path / "deals.csv"
    p.write_text(
        "deal_id,lead_id,rep_id,product,stage,created_at,last_contact_date,close_date,value,outcome\n"
        "D1,L1,R1,p,open,2024-01-05,2024-01-09 13:45:00,,10,open\n"
        "D2,L2,R1,p,closed_won,junk,2024-02-01,2024-02-03,20,closed_won\n")
    rows = io.read_table(spark, str(p), "deals").orderBy("deal_id").collect()
    assert rows[0]["created_at"] == dt.date(2024, 1, 5)
    assert rows[0]["last_contact_date"] == dt.date(2024, 1, 9)   # time part dropped
    assert rows[0]["close_date"] is None
    assert rows[1]["created_at"] is None                          # unparseable -> NULL
    assert rows[1]["value"] == 20


def test_round_trip_and_refresh(spark, crm, tmp_path):
    io.write_csv(crm.deals, str(tmp_path / "csv"))
    back = io.read_table(spark, str(tmp_path / "csv"), "deals")
    assert sorted(back.collect()) == sorted(crm.deals.collect())
    out = str(tmp_path / "crm")
    a = {r["table_name"]: r["rows"] for r in io.full_refresh(spark, crm.as_dict(), out).collect()}
    b = {r["table_name"]: r["rows"] for r in io.full_refresh(spark, crm.as_dict(), out).collect()}
    assert a == b and a["engagement"] == 3255
    rec = io.reconcile(crm.as_dict(), {n: spark.read.parquet(f"{out}/{n}") for n in io.LOAD_ORDER})
    assert all(r["ok"] for r in rec.collect())


def test_csv_fields_with_breaks_quotes_commas(spark, tmp_path):
    schema = "rep_id string, name string"
    from dealgrid.schemas import TABLE_SCHEMAS
    fields = [f.name for f in TABLE_SCHEMAS["reps"].fields]
    rows = [("R1", 'a "quoted", name'), ("R2", "two\nlines"), ("R3", None), ("R4", 'ends "')]
    df = spark.createDataFrame(rows, schema)
    for f in TABLE_SCHEMAS["reps"].fields[2:]:
        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = df.select(*fields)
    io.write_csv(df, str(tmp_path / "reps"))
    back = {r["rep_id"]: r["name"] for r in io.read_table(spark, str(tmp_path / "reps"), "reps").collect()}
    assert back == dict(rows)


def test_csv_rejects_and_load(spark, crm, tmp_path):
    from dealgrid.plans import jobs
    for name, df in crm.as_dict().items():
        io.write_csv(df, str(tmp_path / "csv" / name))
    deals = "deal_id,lead_id,rep_id,product,stage,created_at,last_contact_date,close_date,value,outcome\n"
    (tmp_path / "csv" / "deals" / "extra.csv").write_text(
        deals + "X1,L1,R1,p,open,2024-01-05,2024-01-09,,ten,open\nX2,L1,R1,p\nX3,L1,R1,p,open,bad,2024-01-09,,10,open\n")
    rows, rejects = io.read_checked(spark, str(tmp_path / "csv" / "deals"), "deals")
    bad = {r["row"]["deal_id"]: r["reasons"] for r in rejects.collect()}
    assert set(bad) == {"X1", "X2"} and bad["X1"][0].startswith("value is not") and bad["X2"] == ["wrong number of fields"]
    assert rows.where("deal_id = 'X3' and created_at is null").count() == 1
    report = {r["table_name"]: (r["source_rows"] - r["loaded_rows"], r["ok"])
              for r in jobs.load_csv(spark, str(tmp_path / "csv"), str(tmp_path / "crm")).collect()}
    assert report["deals"] == (2, False) and report["leads"] == (0, True)
    with pytest.raises(Exception, match="value is not"):
        io.read_table(spark, str(tmp_path / "csv" / "deals"), "deals").collect()
