"""Loads: CSV records over many splits, constraints, and publishing by version."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from dealgrid.plans import jobs
from dealgrid.schemas import TABLE_SCHEMAS
from dealgrid.sources import files as io
from dealgrid.sources.constraints import judged
from dealgrid.sources.csv_records import csv_records
from dealgrid.sources.versions import current, list_versions, publish


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["a", "b\nof two lines", "c"])
        w.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_splits_equal_the_whole_file_reader(spark, tmp_path, small_splits, end):
    rng, rows = random.Random(3), []
    for i in range(1500):
        kind = rng.random()
        text = ("plain" if kind < 0.6 else 'two\nlines, "quoted"' if kind < 0.8 else "x\n" * rng.randint(1, 40)
                if kind < 0.95 else "a\r\nb")
        rows.append((str(i), "over many splits\n" * 2000 if i == 700 else text, str(rng.randint(0, 9))))
    _write(tmp_path / "a.csv", rows, end)
    _write(tmp_path / "b.csv", rows[:3], end)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    got = csv_records(spark, str(tmp_path)).orderBy("at").select(F.from_csv("record", "a string, b string, c string", options).alias("x"))
    got = [tuple(r) for r in got.select("x.*").collect()]
    assert got == rows + rows[:3]
    if end != "\n":  # Spark's reader takes the break inside the header for the one that ends records
        return
    ref = spark.read.schema("a string, b string, c string").options(header="true", **options).csv(str(tmp_path))
    assert sorted(got) == sorted(tuple(r) for r in ref.collect())


def test_records_with_open_quote_blank_lines_and_empty_files(spark, tmp_path, small_splits):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "open.csv").write_text('a,b\n1,x\n\n2,"y\n' + "never closed\n" * 3000)
    rows = csv_records(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r.record, r.closed) for r in rows] == [("1,x", True), (None, False)]
    assert rows[1]["at"]["line"] == 3


def test_constraints_in_file_order(spark):
    schema = "deal_id string, lead_id string, rep_id string, product string, stage string, created_at date, " \
             "last_contact_date date, close_date date, value int, outcome string"
    day = "date '2024-01-05'"
    made = [(1, "D1", "LX", "R1"), (2, "D1", "L1", "R1"), (3, "D1", "L1", "R1"), (4, "D2", "L1", None),
            (5, None, "L1", "R1"), (6, "D3", "LX", "RX"), (7, "D2", "L1", "R1")]
    rows = spark.createDataFrame(made, "at int, deal_id string, lead_id string, rep_id string").selectExpr(
        "at", "deal_id", "lead_id", "rep_id", "'p' as product", "'open' as stage", f"{day} as created_at",
        f"{day} as last_contact_date", "cast(null as date) as close_date", "1 as value", "'open' as outcome")
    parents = {"leads": spark.createDataFrame([("L1",)], "lead_id string"), "reps": spark.createDataFrame([("R1",)], "rep_id string")}
    out = {r["at"]: r["reasons"] for r in judged(rows, "deals", parents.get).collect()}
    assert out == {1: ["lead_id is not in leads"], 2: [], 3: ["deal_id repeats"], 4: ["rep_id is null"], 5: ["deal_id is null"],
                   6: ["lead_id is not in leads", "rep_id is not in reps"], 7: []}
    empty = judged(spark.createDataFrame([], "at int, " + schema), "deals", parents.get)
    assert empty.count() == 0 and empty.columns == ["at", *[f.name for f in TABLE_SCHEMAS["deals"].fields], "reasons"]


def test_one_key_in_a_third_of_all_rows(spark):
    rows = spark.range(30000).selectExpr("id as at", "if(id % 3 = 0, 'R', concat('R', id)) as rep_id", "'n' as name",
                                         "date '2024-01-01' as hire_date", "'t' as territory", "1 as annual_quota")
    out = judged(rows, "reps", None).where(F.size("reasons") > 0)
    assert out.count() == 9999 and out.agg(F.min("at")).first()[0] == 3


def test_failed_load_leaves_readers_on_the_old_tables(spark, crm, tmp_path):
    base = str(tmp_path / "crm")
    report = jobs.publish_all(spark, "/root/testdata/sf0.001", base)
    assert all(r["ok"] for r in report.collect())
    before = jobs.read_crm(spark, base)["leads"].count()

    def broken(path):
        io.write_parquet(crm.reps.limit(1), f"{path}/reps")
        raise RuntimeError("lost between two tables")
    with pytest.raises(RuntimeError, match="between two tables"):
        publish(spark, base, broken)
    tables = jobs.read_crm(spark, base)
    assert tables["leads"].count() == before and tables["reps"].count() == crm.reps.count()
    assert list_versions(spark, base) == [1] and current(spark, base).endswith("/v=1")
    jobs.publish_all(spark, "/root/testdata/sf0.001", base)
    assert list_versions(spark, base) == [1, 3]


def test_reader_of_a_place_without_a_complete_version(spark, tmp_path):
    with pytest.raises(RuntimeError):
        publish(spark, str(tmp_path / "x"), lambda path: (_ for _ in ()).throw(RuntimeError("first load")))
    with pytest.raises(FileNotFoundError):
        current(spark, str(tmp_path / "x"))


def test_rows_meet_only_written_keys(spark, tmp_path):
    parents = spark.createDataFrame([("LEAD1",), ("LEAD2",)], "lead_id string")
    rows = spark.range(1, 5).selectExpr(
        "concat('DEAL', id % 3) as deal_id", "nullif(concat('LEAD', id), 'LEAD4') as lead_id", *[
            f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in TABLE_SCHEMAS["deals"].fields if f.name not in ("deal_id", "lead_id")],
        "id as at")
    io.write_parquet(rows, str(tmp_path / "rows"))
    out = judged(spark.read.parquet(str(tmp_path / "rows")), "deals", lambda name: parents if name == "leads" else spark.range(0).selectExpr("'REP1' as rep_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert [("lead_id is not in leads" in r.reasons) for r in out.orderBy("at").collect()] == [False, False, True, False]


def test_csv_without_line_breaks_is_not_searched_for_parts(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x, ""y"""\n\n2,z\r\n')
    got = csv_records(spark, str(tmp_path))
    assert [r.record for r in got.orderBy("at").collect()] == ['1,"x, ""y"""', "2,z"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
