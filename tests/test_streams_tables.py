"""Streams equal their batch operators; table helpers behave like the SQL they replace."""

import datetime as dt
import os
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from medledger.operators import booking as BK
from medledger.operators import changes as C
from medledger.plans import catalog
from medledger.plans.sql_functions import register_sql_functions
from medledger.session import cut_lineage, intermediate_tables
from medledger.sources import schemas as S
from medledger.sources.tables import append_rows, ensure_column, load_tables, tables_present, write_snapshot
from medledger.streaming import streams as ST
from seed import seed_tables


def _write_parts(df, root, splits):
    for i, cond in enumerate(splits):
        df.where(cond).coalesce(1).write.parquet(f"{root}/part{i}")
    return [f"{root}/part{i}" for i in range(len(splits))]


def test_billing_stream_equals_batch(spark, scratch):
    t = seed_tables(spark)
    bills = spark.createDataFrame([
        (f"B{i}", "P1001", "x", dt.date(2025, 1, 1), Decimal(100 - 30 * i), Decimal("0"), None, "Pending")
        for i in range(6)], S.BILLING)
    bills.write.parquet(f"{scratch}/src")
    q = ST.check_billing_stream(spark, f"{scratch}/src", f"{scratch}/ok", f"{scratch}/bad",
                                checkpoint=f"{scratch}/ckpt")
    q.awaitTermination()
    bad = sorted(r["Bill_ID"] for r in spark.read.parquet(f"{scratch}/bad").collect())
    assert bad == ["B4", "B5"]
    assert spark.read.parquet(f"{scratch}/ok").count() == 4
    assert t  # seed tables build


def test_booking_stream_equals_batch(spark, scratch):
    t = seed_tables(spark)
    rows = [(i, "P1001" if i % 2 else "P1002", "D2001" if i % 3 else "D2002", "2025-07-01",
             f"{9 + i // 4:02d}:{(i * 13) % 60:02d}:00", "Cardiology") for i in range(1, 25)]
    req = spark.createDataFrame(rows, S.BOOKING_REQUESTS)
    # Two files in seq order; one file per micro-batch.
    src = f"{scratch}/requests"
    req.where("seq <= 12").coalesce(1).write.parquet(src)
    os.makedirs(src, exist_ok=True)
    req.where("seq > 12").coalesce(1).write.mode("append").parquet(src)
    q = ST.booking_stream(spark, src, t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], f"{scratch}/out",
                          checkpoint=f"{scratch}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    streamed = {r["seq"]: (r["status"], r["reason"], r["Appointment_ID"])
                for r in spark.read.parquet(f"{scratch}/out/outcome").collect()}
    _, _, batch = BK.book_appointments(t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], req)
    expect = {r["seq"]: (r["status"], r["reason"], r["Appointment_ID"]) for r in batch.collect()}
    assert streamed == expect
    assert len([d for d in os.listdir(f"{scratch}/out/appointments_added") if d.startswith("batch_id=")]) >= 2
    added = spark.read.parquet(f"{scratch}/out/appointments_added")
    booked = sorted(r["Appointment_ID"] for r in batch.where("status = 0").collect())
    assert sorted(r["Appointment_ID"] for r in added.collect()) == booked


def test_payment_stream_equals_batch(spark, scratch):
    t = seed_tables(spark)
    pays = spark.createDataFrame([(i, "B6001", "30", None) for i in range(1, 9)], S.PAYMENTS)
    src = f"{scratch}/payments"
    pays.where("seq <= 4").coalesce(1).write.parquet(src)
    pays.where("seq > 4").coalesce(1).write.mode("append").parquet(src)
    q = ST.payment_stream(spark, src, t["BILLING"], f"{scratch}/out", use_version=True,
                          checkpoint=f"{scratch}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    streamed = {r["seq"]: (r["Amount_Paid"], r["Payment_Status"], r["version"])
                for r in spark.read.parquet(f"{scratch}/out/outcome").collect()}
    batch_bills, batch = C.apply_payments(t["BILLING"], pays, use_version=True)
    assert streamed == {r["seq"]: (r["Amount_Paid"], r["Payment_Status"], r["version"]) for r in batch.collect()}
    now = ST.current_bills(spark, t["BILLING"].withColumn("version", F.lit(1)), f"{scratch}/out")
    assert [tuple(r) for r in now.collect()] == [tuple(r) for r in batch_bills.collect()]


def _feed(spark, path, rows, schema):
    """One file per list of rows, so one micro-batch each."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times


def test_payments_repeated_or_late_across_batches(spark, scratch):
    t = seed_tables(spark)
    call = lambda seq, amount: (seq, "B6001", amount, None)
    _feed(spark, f"{scratch}/src", [[call(5, "10"), call(6, "20"), call(6, "20")], [call(6, "20"), call(7, "30")], [call(2, "1"), call(5, "10"), call(9, "2")]], S.PAYMENTS)
    ST.payment_stream(spark, f"{scratch}/src", t["BILLING"], f"{scratch}/out", use_version=True, checkpoint=f"{scratch}/ckpt",
                      max_files_per_trigger=1).awaitTermination()
    out = {r["seq"]: (r["batch_id"], r["late"], r["version"], r["Amount_Paid"]) for r in spark.read.parquet(f"{scratch}/out/outcome").collect()}
    start = t["BILLING"].where("Bill_ID = 'B6001'").first()["Amount_Paid"]
    assert {k: (*v[:3], v[3] - start) for k, v in out.items()} == {
        5: (0, False, 2, 10), 6: (0, False, 3, 30), 7: (1, False, 4, 60), 2: (2, True, 5, 61), 9: (2, False, 6, 63)}
    assert spark.read.parquet(f"{scratch}/out/outcome").count() == 5
    assert sorted((r["batch_id"], r["seq"]) for r in spark.read.parquet(f"{scratch}/out/repeated").collect()) == [(1, 6), (2, 5)]
    now = ST.current_bills(spark, t["BILLING"].withColumn("version", F.lit(1)), f"{scratch}/out").where("Bill_ID = 'B6001'").first()
    assert now["Amount_Paid"] - start == 63 and now["version"] == 6


def test_a_booking_call_in_two_files_is_booked_once(spark, scratch):
    t = seed_tables(spark)
    call = lambda seq, at: (seq, "P1001", "D2001", "2025-07-01", at, "Cardiology")
    _feed(spark, f"{scratch}/src", [[call(3, "09:00:00")], [call(3, "09:00:00"), call(4, "11:00:00")], [call(1, "11:10:00"), call(2, "13:00:00")]], S.BOOKING_REQUESTS)
    ST.booking_stream(spark, f"{scratch}/src", t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], f"{scratch}/out",
                      checkpoint=f"{scratch}/ckpt", max_files_per_trigger=1).awaitTermination()
    out = {r["seq"]: (r["batch_id"], r["late"], r["status"]) for r in spark.read.parquet(f"{scratch}/out/outcome").collect()}
    assert out == {3: (0, False, 0), 4: (1, False, 0), 1: (2, True, -1), 2: (2, True, 0)}
    assert spark.read.parquet(f"{scratch}/out/appointments_added").count() == 3


def test_a_booking_stream_stores_a_batch_once_and_checked(spark, scratch, monkeypatch):
    """The texts of a batch are stored once, in the job that checks them; faulty, repeated and unknown calls keep their outcomes."""
    t = seed_tables(spark)
    stored, cut = [], BK.cut_lineage
    note = lambda df: (stored.append(df.columns), cut(df))[1]
    monkeypatch.setattr(BK, "cut_lineage", note)
    monkeypatch.setattr(ST, "cut_lineage", note)
    call = lambda seq, at, patient="P1001", doctor="D2001": (seq, patient, doctor, "2025-07-01", at, "Cardiology")
    _feed(spark, f"{scratch}/src", [[call(1, " 9:0:0 "), call(2, "25:00:00"), call(3, "9:29:59")],
                                    [call(4, "9:30:0"), call(5, "12:00:00", " P0"), call(6, "14:00:00", doctor="D0")]], S.BOOKING_REQUESTS)
    ST.booking_stream(spark, f"{scratch}/src", t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], f"{scratch}/out",
                      checkpoint=f"{scratch}/ckpt", max_files_per_trigger=1).awaitTermination()
    got = {r["seq"]: (r["batch_id"], r["Patient_ID"], r["Appointment_Time"], r["status"], r["reason"])
           for r in spark.read.parquet(f"{scratch}/out/outcome").collect()}
    assert got == {1: (0, "P1001", "09:00:00", 0, None), 2: (0, "P1001", "25:00:00", None, "invalid_request"),
                   3: (0, "P1001", "09:29:59", -1, "patient"), 4: (1, "P1001", "09:30:00", 0, None),
                   5: (1, "P0", "12:00:00", None, "unknown_patient"), 6: (1, "P1001", "14:00:00", None, "unknown_doctor")}
    assert sum("Appointment_Time" in columns for columns in stored) == 2  # one table in each of the two batches


def test_a_feed_has_files_by_its_rows(spark, scratch, monkeypatch):
    """A larger feed is read by more tasks: steps of ascending ``seq`` as before, in files of bounded size."""
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 50)
    calls = spark.range(600).select(F.col("id").alias("seq"), F.lit("x").alias("text"))
    assert catalog._feed(None, calls, f"{scratch}/large", parts=2) == 7
    assert catalog._feed(None, calls.where("seq < 100"), f"{scratch}/small", parts=2) == 4
    fed = spark.read.parquet(f"{scratch}/large")
    assert sorted(r["seq"] for r in fed.collect()) == list(range(600))
    files = fed.groupBy(F.input_file_name()).agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) == 14 and max(f["n"] for f in files) < 150 and not any(f["low"] < 300 <= f["high"] for f in files)


def test_two_streams_at_once_and_nested_scopes(spark, scratch):
    """A scope that ends takes its own tables only, in its own thread only."""
    t = seed_tables(spark)
    with intermediate_tables(spark):
        with intermediate_tables(spark):
            pass
        outer = cut_lineage(spark.range(3))
        done = []

        def other():
            with intermediate_tables(spark):
                done.append(cut_lineage(spark.range(4)).count())

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert done == [4] and outer.count() == 3
        where = outer.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(where)
    pays = [(i, "B6001", "1", None) for i in range(12)]
    calls = [(i, "P1001", "D2001", "2025-07-01", f"{8 + i:02d}:00:00", "Cardiology") for i in range(12)]
    for part in range(3):
        spark.createDataFrame(pays[part * 4 : part * 4 + 4], S.PAYMENTS).coalesce(1).write.mode("append").parquet(f"{scratch}/pays")
        spark.createDataFrame(calls[part * 4 : part * 4 + 4], S.BOOKING_REQUESTS).coalesce(1).write.mode("append").parquet(f"{scratch}/calls")
    one = ST.payment_stream(spark, f"{scratch}/pays", t["BILLING"], f"{scratch}/p", checkpoint=f"{scratch}/cp", max_files_per_trigger=1)
    two = ST.booking_stream(spark, f"{scratch}/calls", t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], f"{scratch}/b",
                            checkpoint=f"{scratch}/cb", max_files_per_trigger=1)
    one.awaitTermination()
    two.awaitTermination()
    assert one.exception() is None and two.exception() is None
    assert spark.read.parquet(f"{scratch}/p/outcome").where("ok").count() == 12
    assert spark.read.parquet(f"{scratch}/b/outcome").where("status = 0").count() == 12


def test_sql_function(spark):
    t = seed_tables(spark)
    t["BILLING"].createOrReplaceTempView("seed_billing")
    t["PATIENT"].createOrReplaceTempView("seed_patient")
    register_sql_functions(spark, "seed_billing")
    register_sql_functions(spark, "seed_billing")  # idempotent
    got = {r[0]: r[1] for r in spark.sql(
        "SELECT Patient_ID, CalculateOutstandingBill(Patient_ID) FROM seed_patient").collect()}
    assert got == {"P1001": Decimal("200.00"), "P1002": Decimal("0.00")}


def test_table_helpers(spark, scratch):
    t = seed_tables(spark)
    for name, df in t.items():
        df.write.parquet(f"{scratch}/db/{name}")
    loaded = load_tables(spark, f"{scratch}/db")
    assert {n: d.count() for n, d in loaded.items()} == {n: d.count() for n, d in t.items()}
    bad = t["BILLING"].drop("Amount_Paid")
    bad.write.parquet(f"{scratch}/bad/BILLING")
    with pytest.raises(ValueError):
        load_tables(spark, f"{scratch}/bad", ["BILLING"])

    b = ensure_column(t["BILLING"], "version", "int", 1)
    assert b.first()["version"] == 1 and ensure_column(b, "version", "int", 7).first()["version"] == 1

    b2 = append_rows(b, [{"Bill_ID": "B9999", "Patient_ID": "P1001", "Service_Type": "Test",
                          "Service_Date": dt.date(2025, 1, 1), "Amount_Charged": Decimal("100"),
                          "Amount_Paid": Decimal("0"), "Payment_Status": "Pending"}])
    row = b2.where("Bill_ID = 'B9999'").first()
    assert row["Payment_Date"] is None and row["version"] == 1 and b2.count() == 2
    b3 = append_rows(t["BILLING"], [("B9998", "P1001", "Test", dt.date(2025, 1, 1), Decimal("1"), Decimal("0"),
                                     None, "Pending")])
    assert b3.count() == 2

    t["PATIENT"].createOrReplaceTempView("PATIENT")
    present = {r["name"]: r["present"] for r in tables_present(spark, ["PATIENT", "DOCTOR"]).collect()}
    assert present == {"PATIENT": True, "DOCTOR": False}

    src = spark.read.parquet(f"{scratch}/db/BILLING")
    with pytest.raises(ValueError):
        write_snapshot(src.withColumn("Payment_Status", F.lit("Paid")), f"{scratch}/db/BILLING")
    write_snapshot(src, f"{scratch}/db2/BILLING")
    assert spark.read.parquet(f"{scratch}/db2/BILLING").count() == 1
