"""Seed-row scenarios and boundary cases of the reference's demo and notes."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from medledger.operators import booking as BK
from medledger.operators import changes as C
from medledger.operators import quality as Q
from medledger.operators import reports as R
from medledger.sources import schemas as S
from seed import seed_tables


def _requests(spark, rows):
    return spark.createDataFrame(rows, S.BOOKING_REQUESTS)


def _book(spark, t, rows, as_of=None, appts=None, distinct_codes=False):
    appts = t["APPOINTMENT"] if appts is None else appts
    a, b, o = BK.book_appointments(appts, t["BILLING"], t["PATIENT"], t["DOCTOR"], _requests(spark, rows),
                                   as_of=as_of, distinct_codes=distinct_codes)
    return a, b, {r["seq"]: r for r in o.collect()}


def test_booking_conflict_scenario(spark):
    t = seed_tables(spark)
    rows = [(1, "P1001", "D2001", "2025-07-01", "10:00:00", "Cardiology"),
            (2, "P1001", "D2001", "2025-07-01", "10:15:00", "Cardiology")]
    a, b, o = _book(spark, t, rows)
    assert o[1]["status"] == 0 and o[2]["status"] == -1
    assert o[2]["reason"] == "patient"
    assert o[1]["Appointment_ID"] == "A3002" and o[1]["Bill_ID"] == "B6002"
    assert o[1]["message"] == "Appointment booked successfully. ID: A3002"
    new = a.where(F.col("Appointment_ID") == "A3002").first()
    assert new["Status"] == "Scheduled" and new["Appointment_Time"] == "10:00:00" and new["version"] == 1
    bill = b.where(F.col("Bill_ID") == "B6002").first()
    assert bill["Service_Type"] == "Cardiology Consultation"
    assert bill["Amount_Charged"] == Decimal("200.00") and bill["Payment_Status"] == "Pending"
    assert a.count() == 2 and b.count() == 2


def test_booking_window_edges(spark):
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2002", "2025-07-02", "10:00:00", "Neurology"),
            (2, "P1002", "D2002", "2025-07-02", "10:29:59", "Neurology"),   # 29m59s: conflict
            (3, "P1002", "D2002", "2025-07-02", "10:30:00", "Neurology"),   # exactly 30 min: free
            (4, "P1002", "D2002", "2025-07-02", "23:50:00", "Neurology"),
            (5, "P1002", "D2002", "2025-07-03", "00:10:00", "Neurology")]   # next day: free
    _, _, o = _book(spark, t, rows)
    assert [o[i]["status"] for i in range(1, 6)] == [0, -1, 0, 0, 0]


def test_canceled_slot_still_blocks(spark):
    t = seed_tables(spark)
    appts = t["APPOINTMENT"].withColumn("Status", F.lit("Canceled"))
    _, _, o = _book(spark, t, [(1, "P1001", "D2002", "2025-06-15", "10:10:00", "Neurology")], appts=appts)
    assert o[1]["status"] == -1 and o[1]["reason"] == "patient"


def test_doctor_conflict_codes(spark):
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2001", "2025-06-15", "10:20:00", "Cardiology")]
    _, _, o = _book(spark, t, rows)
    assert o[1]["status"] == -1 and o[1]["reason"] == "doctor"
    _, _, o = _book(spark, t, rows, distinct_codes=True)
    assert o[1]["status"] == -2


def test_chain_accept_reject_accept(spark):
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2002", "2025-08-01", "10:00:00", "Neurology"),
            (2, "P1002", "D2002", "2025-08-01", "10:20:00", "Neurology"),
            (3, "P1002", "D2002", "2025-08-01", "10:40:00", "Neurology")]
    _, _, o = _book(spark, t, rows)
    assert [o[i]["status"] for i in (1, 2, 3)] == [0, -1, 0]
    assert o[3]["Appointment_ID"] == "A3003"


def test_past_date_and_missing_parents(spark):
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2002", "2025-01-05", "09:00:00", "Neurology"),   # past, no conflict
            (2, "P1001", "D2001", "2025-06-15", "10:05:00", "Cardiology"),  # past, conflict first
            (3, "P9999", "D2002", "2025-09-01", "09:00:00", "Neurology"),   # unknown patient
            (4, "P1002", "D2002", "2025-09-01", "09:10:00", "Neurology"),   # not blocked by 3
            (5, "P1002", "D9999", "2025-09-01", "12:00:00", "Neurology")]   # unknown doctor
    _, _, o = _book(spark, t, rows, as_of="2025-06-01")
    assert o[1]["status"] is None and o[1]["reason"] == "past_date"
    assert o[1]["message"] == "Cannot schedule an appointment in the past."
    assert o[2]["status"] == -1
    assert o[3]["status"] is None and o[3]["reason"] == "unknown_patient"
    assert o[4]["status"] == 0
    assert o[5]["reason"] == "unknown_doctor"


def test_booking_request_validation(spark):
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2002", "2025-6-5", "9:5:3", "Neurology"),
            (2, "P1002", "D2002", "2025-02-30", "10:00:00", "Neurology"),
            (3, "P1002", "D2002", "25-06-05", "10:00:00", "Neurology"),
            (4, "P1002", "D2002", "2025-07-05", "10:00:60", "Neurology"),
            (5, "P1002", "D2002", "2025-07-05", "24:00:00", "Neurology"),
            (6, " P1002 ", "D2002", "2025-07-05", "11:00:00", "   "),
            (7, "P1002", None, "2025-07-05", "11:00:00", "Neurology")]
    _, _, o = _book(spark, t, rows)
    assert o[1]["status"] == 0 and o[1]["Appointment_Time"] == "09:05:03"
    assert o[1]["Appointment_Date"] == dt.date(2025, 6, 5)
    assert o[2]["message"] == o[3]["message"] == "Invalid date format. Use YYYY-MM-DD"
    assert o[4]["message"] == o[5]["message"] == "Invalid time format. Use HH:MM:SS"
    assert o[6]["message"] == o[7]["message"] == "All fields are required"


def test_next_id_never_truncates(spark):
    t = seed_tables(spark)
    appts = t["APPOINTMENT"].withColumn("Appointment_ID", F.lit("A9999"))
    _, _, o = _book(spark, t, [(1, "P1002", "D2002", "2025-07-01", "10:00:00", "Neurology")], appts=appts)
    assert o[1]["Appointment_ID"] == "A10000"


def test_billing_and_date_rules(spark):
    t = seed_tables(spark)
    bills = spark.createDataFrame([
        ("B9999", "P1001", "Test", dt.date(2025, 1, 1), Decimal("-100"), Decimal("0"), None, "Pending"),
        ("B9998", "P1001", "Test", dt.date(2025, 1, 1), Decimal("100"), Decimal("0"), None, "Pending"),
    ], S.BILLING)
    ok, bad = Q.check_billing(bills)
    assert [r["Bill_ID"] for r in ok.collect()] == ["B9998"]
    assert [r["message"] for r in bad.collect()] == ["Negative billing amounts are not allowed."]
    appts = spark.createDataFrame([
        ("A9999", "P1001", "D2001", "Cardiology", dt.date(2020, 1, 1), "10:00:00", "Scheduled"),
        ("A9998", "P1001", "D2001", "Cardiology", dt.date(2025, 12, 31), "10:00:00", "Scheduled"),
    ], S.APPOINTMENT)
    ok, bad = Q.check_appointment_date(appts, "2025-06-01")
    assert [r["Appointment_ID"] for r in ok.collect()] == ["A9998"]
    assert bad.first()["message"] == "Cannot schedule an appointment in the past."
    failed = False
    try:
        Q.check_billing(bills, fail=True).collect()
    except Exception as e:  # the trigger's SIGNAL becomes a failed job
        failed = "Negative billing amounts are not allowed." in str(e)
    assert failed


def _pays(spark, rows):
    return spark.createDataFrame([(*r, None)[:4] for r in rows], S.PAYMENTS)


def test_payments_scenario(spark):
    t = seed_tables(spark)
    pays = _pays(spark, [(1, "B6001", "100"), (2, "B6001", "100.00"), (3, "B0000", "5"), (4, "B6001", "abc"),
                         (5, "B6001", "0"), (6, "B6001", "-5"), (7, "B6001", "NaN"), (8, None, "5")])
    bills, out = C.apply_payments(t["BILLING"], pays, use_version=True)
    o = {r["seq"]: r for r in out.collect()}
    assert o[1]["Payment_Status"] == "Pending" and o[1]["Amount_Paid"] == Decimal("100.00")
    assert o[2]["Payment_Status"] == "Paid" and o[2]["version"] == 3
    assert o[3]["reason"] == o[8]["reason"] == "not_found"
    assert o[3]["message"] == "Payment failed - record was modified by another transaction"
    assert all(o[i]["reason"] == "invalid_request" for i in (4, 5, 6, 7))
    b = bills.first()
    assert b["Amount_Paid"] == Decimal("200.00") and b["Payment_Status"] == "Paid" and b["version"] == 3
    assert b["Payment_Date"] is None


def test_payment_on_negative_paid_bill(spark):
    bills = spark.createDataFrame([
        ("B1", "P1", "x", dt.date(2025, 1, 1), Decimal("100"), Decimal("-50"), None, "Pending"),
        ("B2", "P1", "x", dt.date(2025, 1, 1), Decimal("-10"), Decimal("0"), None, "Pending"),
    ], S.BILLING)
    pays = _pays(spark, [(1, "B1", "20"), (2, "B1", "60"), (3, "B1", "10"), (4, "B2", "5")])
    _, out = C.apply_payments(bills, pays)
    o = {r["seq"]: r for r in out.collect()}
    assert [o[i]["ok"] for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert o[2]["Amount_Paid"] == Decimal("10.00") and o[3]["Amount_Paid"] == Decimal("20.00")


def test_status_changes(spark):
    t = seed_tables(spark)
    changes = spark.createDataFrame([(1, "A3001", "complete"), (2, "A0000", "cancel"), (3, "A3001", "cancel")],
                                    S.STATUS_CHANGES)
    a, b, out = C.apply_status_changes(t["APPOINTMENT"], t["BILLING"], changes)
    assert a.first()["Status"] == "Canceled" and b.first()["Payment_Status"] == "Void"
    o = {r["seq"]: r for r in out.collect()}
    assert o[1]["message"] == "Appointment marked as completed" and o[2]["reason"] == "not_found"
    a, b, _ = C.apply_status_changes(t["APPOINTMENT"], t["BILLING"], changes.where("seq = 1"))
    assert a.first()["Status"] == "Completed" and b.first()["Payment_Status"] == "Processing"


def test_lab_updates(spark):
    t = seed_tables(spark)
    ups = spark.createDataFrame([(1, "L4001", "Normal"), (2, "L0000", "Normal"), (3, "L4001", " "),
                                 (4, "L4001", "x" * 21)], S.LAB_UPDATES)
    labs, out = C.update_lab_results(t["LABTEST"], ups)
    assert labs.where("Lab_Order_ID = 'L4001'").first()["Result"] == "Normal"
    o = {r["seq"]: r for r in out.collect()}
    assert o[1]["message"] == "Lab result updated successfully"
    assert o[2]["message"] == "No records updated - check Lab Order ID"
    assert o[3]["message"] == "Both fields are required"
    assert o[4]["reason"] == "too_long"


def test_reports_on_seed(spark):
    t = seed_tables(spark)
    assert R.outstanding_bill(t["PATIENT"], t["BILLING"]).orderBy("Patient_ID").collect()[1]["Outstanding_Bill"] \
        == Decimal("0.00")
    stats = {r["Doctor_ID"]: r for r in R.doctor_appointment_stats(t["DOCTOR"], t["APPOINTMENT"]).collect()}
    assert (stats["D2002"]["Total_Appointments"], stats["D2002"]["Completed_Appointments"]) == (0, 0)
    labs = [r["Lab_Order_ID"] for r in R.pending_lab_tests_before(t["LABTEST"], "2025-06-20").collect()]
    assert labs == ["L4001"]
    rx = [r["Prescription_ID"] for r in
          R.prescriptions_between(t["PRESCRIPTION"], t["DOCTOR"], "2025-06-15", "2025-06-25").collect()]
    assert rx == ["PR5001", "PR5002"]
    hist = R.patient_appointment_history(t["APPOINTMENT"], t["DOCTOR"], "P1001").collect()
    assert [r["Doctor_Name"] for r in hist] == ["Dr. Adams"]
    counts = {r["Table_Name"]: r["Record_Count"] for r in R.row_counts(t).collect()}
    assert counts == {"PATIENT": 2, "DOCTOR": 2, "APPOINTMENT": 1, "LABTEST": 2, "PRESCRIPTION": 3, "BILLING": 1}


def test_update_and_delete(spark):
    t = seed_tables(spark)
    b = t["BILLING"]
    reset = C.update_where(b, F.col("Bill_ID") == "B6001", {"Amount_Paid": 100})
    assert reset.first()["Amount_Paid"] == Decimal("100.00")
    assert C.affected_rows(b, F.col("Bill_ID") == "B6001").first()["affected_rows"] == 1
    # A NULL condition keeps the row (Payment_Date is NULL).
    assert C.delete_where(b, F.col("Payment_Date") < F.lit("2030-01-01").cast("date")).count() == 1
    assert C.delete_where(b, F.col("Bill_ID") == "B6001").count() == 0


def test_booking_rejects_ambiguous_order(spark):
    import pytest
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2002", "2025-07-01", "10:00:00", "Neurology"),
            (1, "P1002", "D2002", "2025-07-01", "10:10:00", "Neurology")]
    with pytest.raises(ValueError):
        _book(spark, t, rows)


def test_book_new_rows_and_version_default(spark):
    t = seed_tables(spark)
    rows = [(1, "P1002", "D2002", "2025-07-01", "10:00:00", "Neurology")]
    new_a, new_b, out = BK.book_new_rows(t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"],
                                         _requests(spark, rows))
    assert [r["Appointment_ID"] for r in new_a.collect()] == ["A3002"]
    assert [r["Bill_ID"] for r in new_b.collect()] == ["B6002"]
    a, b, _ = BK.book_appointments(t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], _requests(spark, rows))
    # Tables without a version column get it with DEFAULT 1 for the existing rows.
    assert sorted((r["Appointment_ID"], r["version"]) for r in a.collect()) == [("A3001", 1), ("A3002", 1)]
    assert sorted((r["Bill_ID"], r["version"]) for r in b.collect()) == [("B6001", 1), ("B6002", 1)]
    assert out.count() == 1


def test_empty_batches(spark):
    t = seed_tables(spark)
    a, b, out = BK.book_appointments(t["APPOINTMENT"], t["BILLING"], t["PATIENT"], t["DOCTOR"], _requests(spark, []))
    assert out.count() == 0 and a.count() == 1 and b.count() == 1
    bills, pay_out = C.apply_payments(t["BILLING"], spark.createDataFrame([], S.PAYMENTS))
    assert pay_out.count() == 0 and bills.first()["Amount_Paid"] == Decimal("0.00")
    appts, bills, ch_out = C.apply_status_changes(t["APPOINTMENT"], t["BILLING"],
                                                  spark.createDataFrame([], S.STATUS_CHANGES))
    assert ch_out.count() == 0 and appts.first()["Status"] == "Scheduled"


def test_rule_order_and_null_conditions(spark):
    df = spark.createDataFrame([(1, -5, None), (2, 5, -1), (3, None, None), (4, -1, -1)], "id int, a int, b int")
    rules = [Q.Rule("a_negative", F.col("a") < 0, "a < 0"), Q.Rule("b_negative", F.col("b") < 0, "b < 0")]
    ok, bad = Q.split_valid(df, rules)
    assert sorted(r["id"] for r in ok.collect()) == [3]
    assert sorted((r["id"], r["rule"]) for r in bad.collect()) == [(1, "a_negative"), (2, "b_negative"),
                                                                   (4, "a_negative")]
