"""Tables by month, tables of the catalog, footers, the report as a table function, collated equality."""

import datetime as dt
import os
import uuid

import pytest

from pyspark.sql import functions as F

from medledger.operators import reports as R
from medledger.plans.sql_functions import register_report_function
from medledger.sources import schemas as SC
from medledger.sources import stored as SD
from medledger.sources.tables import write_snapshot
from seed import seed_tables
from test_plans import _plan


def _labs(spark, days):
    return spark.createDataFrame([(f"L{k}", "P1", "Blood Test", d, d, "Pending") for k, d in enumerate(days)],
                                 "Lab_Order_ID string, Patient_ID string, Test_Type string, Order_Date date, Scheduled_Date date, Result string")


def _files(path):
    return {m: sorted(os.listdir(f"{path}/{m}")) for m in os.listdir(path) if "=" in m}


def test_reports_read_the_months_of_their_dates(spark, scratch):
    days = [dt.date(2025, m, d) for m in range(1, 13) for d in (1, 20, 28)] + [None]
    labs = _labs(spark, days)
    SD.write_by_month(labs, f"{scratch}/labs", "Scheduled_Date", "Lab_Order_ID")
    stored = spark.read.parquet(f"{scratch}/labs")
    got = R.pending_lab_tests_before(stored, "2025-03-20")
    assert "PartitionFilters: [isnotnull(Scheduled_Date_Month" in _plan(got) and "<= 202503" in _plan(got)
    assert sorted(got.collect()) == sorted(R.pending_lab_tests_before(labs, "2025-03-20").collect()) and got.count() == 7
    rx = labs.select(F.col("Lab_Order_ID").alias("Prescription_ID"), "Patient_ID", F.lit("D2001").alias("Doctor_ID"),
                     F.col("Scheduled_Date").alias("Date_Issued"), F.lit("m").alias("Medication_Name"), F.lit("1").alias("Dosage"))
    SD.write_by_month(rx, f"{scratch}/rx", "Date_Issued", "Prescription_ID")
    doctors = seed_tables(spark)["DOCTOR"]
    got = R.prescriptions_between(spark.read.parquet(f"{scratch}/rx"), doctors, "2025-02-28", "2025-04-01")
    assert ">= 202502" in _plan(got) and "<= 202504" in _plan(got)
    assert got.collect() == R.prescriptions_between(rx, doctors, "2025-02-28", "2025-04-01").collect() and got.count() == 5


def test_months_without_new_rows_keep_their_files(spark, scratch):
    path = f"{scratch}/labs"
    SD.write_by_month(_labs(spark, [dt.date(2025, m, 5) for m in (1, 2, 3)]), path, "Scheduled_Date", "Lab_Order_ID")
    before = _files(path)
    SD.write_by_month(_labs(spark, [dt.date(2025, 2, 9)]), path, "Scheduled_Date", "Lab_Order_ID", mode="append")
    after = _files(path)
    assert [m for m in before if before[m] != after[m]] == ["Scheduled_Date_Month=202502"]
    assert set(before["Scheduled_Date_Month=202502"]) < set(after["Scheduled_Date_Month=202502"])
    # The tests of March are changed: only that folder is written again.
    stored = spark.read.parquet(path)
    changed = SD.months_touched(stored, _labs(spark, [dt.date(2025, 3, 5)]), "Scheduled_Date").withColumn("Result", F.lit("Normal"))
    rows = [tuple(r) for r in changed.drop("Scheduled_Date_Month").collect()]
    SD.write_by_month(spark.createDataFrame(rows, SC.LABTEST), path, "Scheduled_Date", "Lab_Order_ID", mode="replace")
    last = _files(path)
    assert [m for m in after if after[m] != last[m]] == ["Scheduled_Date_Month=202503"]
    assert sorted(r.Result for r in spark.read.parquet(path).collect()) == ["Normal", "Pending", "Pending", "Pending"]


def test_counts_and_extents_come_from_footers(spark, scratch):
    tables = seed_tables(spark)
    for name, df in tables.items():
        write_snapshot(df, f"{scratch}/{name}")
    counts = SD.footer_counts(spark, {name: f"{scratch}/{name}" for name in tables})
    assert _plan(counts).count("PushedAggregation: [COUNT(*)]") == len(tables)
    assert {r.Table_Name: r.Record_Count for r in counts.collect()} == {n: df.count() for n, df in tables.items()}
    extent = SD.footer_extent(spark, f"{scratch}/LABTEST", "Scheduled_Date")
    assert "MIN(Scheduled_Date)" in _plan(extent) and "PushedAggregation: [COUNT(*)" in _plan(extent)
    assert tuple(extent.first()) == (2, dt.date(2025, 6, 12), dt.date(2025, 6, 20))
    write_snapshot(tables["LABTEST"].limit(0), f"{scratch}/none")
    assert tuple(SD.footer_extent(spark, f"{scratch}/none", "Scheduled_Date").first()) == (0, None, None)
    assert SD.footer_counts(spark, {"none": f"{scratch}/none"}).first().Record_Count == 0
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


@pytest.fixture()
def database(spark, scratch):
    name = f"t_{uuid.uuid4().hex[:12]}"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_catalog_tables_hold_lengths_and_defaults(spark, scratch, database):
    SD.create_tables(spark, database, f"{scratch}/db")
    tables = seed_tables(spark)
    for name, df in tables.items():
        SD.insert_rows(spark, database, name, df)
        assert spark.table(f"{database}.{name}").count() == df.count()
    too_long = tables["PATIENT"].withColumn("Patient_ID", F.lit("P" * 11))
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        SD.insert_rows(spark, database, "PATIENT", too_long)
    assert spark.table(f"{database}.PATIENT").count() == tables["PATIENT"].count()
    SD.add_column(spark, database, "BILLING")
    SD.add_column(spark, database, "BILLING")
    SD.insert_rows(spark, database, "BILLING", tables["BILLING"].withColumn("Bill_ID", F.lit("B2")))
    SD.insert_rows(spark, database, "BILLING", tables["BILLING"].withColumn("Bill_ID", F.lit("B3")).withColumn("version", F.lit(4)))
    got = {r.Bill_ID: r.version for r in spark.table(f"{database}.BILLING").collect()}
    assert got == {"B6001": 1, "B2": 1, "B3": 4}


def test_bucketed_tables_join_without_a_shuffle(spark, scratch, database):
    SD.create_tables(spark, database, f"{scratch}/db", buckets=4)
    tables = seed_tables(spark)
    for name, df in tables.items():
        SD.insert_rows(spark, database, name, df)
    t = {name: spark.table(f"{database}.{name}") for name in tables}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = R.outstanding_bills(t["PATIENT"], t["BILLING"])
        assert "Exchange" not in _plan(got) and "SortMergeJoin" in _plan(got)
        assert got.collect() == R.outstanding_bills(tables["PATIENT"], tables["BILLING"]).collect() and got.count() == 1
        assert "hashpartitioning" not in _plan(R.doctor_appointment_stats(t["DOCTOR"], t["APPOINTMENT"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_report_function_is_one_join(spark):
    t = seed_tables(spark)
    R.patient_report(t["APPOINTMENT"], t["LABTEST"], t["BILLING"]).createOrReplaceTempView("report_rows")
    t["PATIENT"].createOrReplaceTempView("report_patients")
    register_report_function(spark, "report_rows")
    got = spark.sql("SELECT p.Patient_ID, r.* FROM report_patients p, LATERAL PatientReport(p.Patient_ID) r")
    plan = _plan(got)
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.table("report_rows").select(*got.columns).collect()))
    one = spark.sql("SELECT section, record_id FROM PatientReport('P1002')").collect()
    assert [tuple(r) for r in one] == [("lab_tests", "L4002")]


def test_collated_lookup(spark):
    df = spark.createDataFrame([("Pending",), ("PENDING ",), (" Pending",), ("Paid",), (None,)], "s string")
    assert [r.s for r in R.lookup(df, "s", "pending   ", collation="UTF8_LCASE_RTRIM").collect()] == ["Pending", "PENDING "]
    assert R.lookup(df, "s", "pending").count() == 0
