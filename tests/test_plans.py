"""Plan guards for every registered query: no pair-producing joins, no unpartitioned windows,
filters reach the scan."""

import contextlib
import io
import re

import pytest

from conftest import SMALL_SF

from medledger.plans import catalog

# One query of each operator: a stream's result is a plain read, and the booking queries share one plan.
QUERIES = {n: q for n, q in catalog.QUERIES.items()
           if "stream" not in n and (not n.startswith("booking_") or n == "booking_full_book_outcome")}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_pairs_or_global_windows(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL_SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # A window must name partition keys: "Arguments: [..], [keys], [order]" with non-empty keys.
    for args in re.findall(r"\(\d+\) Window\s*\nInput.*\nArguments: (.*)", plan):
        assert "], [], [" not in args, args


def test_filters_reach_the_scan(spark, scratch):
    from medledger.operators import reports as R
    from medledger.sources.tables import load_tables
    from seed import seed_tables
    for name, df in seed_tables(spark).items():
        df.write.parquet(f"{scratch}/{name}")
    t = load_tables(spark, scratch)
    plan = _plan(R.pending_lab_tests_before(t["LABTEST"], "2025-06-20"))
    assert "EqualTo(Result,Pending)" in plan and "LessThan(Scheduled_Date,2025-06-20)" in plan
    assert "ReadSchema: struct<Lab_Order_ID:string,Patient_ID:string,Test_Type:string,Scheduled_Date:date," \
           "Result:string>" in plan
    plan = _plan(R.outstanding_bills(t["PATIENT"], t["BILLING"]))
    assert "EqualTo(Payment_Status,Pending)" in plan
    assert "ReadSchema: struct<Patient_ID:string,Amount_Charged:decimal(10,2),Amount_Paid:decimal(10,2)," \
           "Payment_Status:string>" in plan


def _stored(spark, scratch):
    from medledger.sources.tables import load_tables
    from seed import seed_tables
    for name, df in seed_tables(spark).items():
        df.write.parquet(f"{scratch}/{name}")
    return load_tables(spark, scratch)


def test_audits_read_each_table_once(spark, scratch):
    from medledger.operators import quality as Q
    t = _stored(spark, scratch)
    scans = lambda df: len(re.findall(r"^\(\d+\) Scan parquet", _plan(df), re.M))
    assert scans(Q.audit_primary_key(t["BILLING"], "Bill_ID")) == 1
    assert scans(Q.audit_foreign_key(t["BILLING"], "Patient_ID", t["PATIENT"], "Patient_ID", "Bill_ID")) == 2
    assert scans(Q.audit_not_null(t["BILLING"], ["Bill_ID", "Patient_ID"])) == 1


def test_reports_do_not_aggregate_the_named_tables(spark, scratch):
    from medledger.operators import reports as R
    t = _stored(spark, scratch)
    plan = _plan(R.outstanding_bills(t["PATIENT"], t["BILLING"]))
    assert plan.count("hashpartitioning") <= 2 and len(re.findall(r"^\(\d+\) HashAggregate", plan, re.M)) == 2
    plan = _plan(R.doctor_appointment_stats(t["DOCTOR"], t["APPOINTMENT"]))
    assert len(re.findall(r"^\(\d+\) HashAggregate", plan, re.M)) == 2
