"""Order-dependent operators against a plain sequential loop on seeded random batches."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from medledger.operators import booking as BK
from medledger.operators import changes as C
from medledger.operators.ordering import global_rank, running_sums
from medledger.sources import schemas as S


def _sequential_booking(existing, requests, patients, doctors, as_of):
    """The routine's rule, one call at a time."""
    acc = [(p, d, day, sec) for p, d, day, sec in existing]
    out = {}
    for seq, p, d, day, sec in sorted(requests):
        near_p = any(a[0] == p and a[2] == day and abs(a[3] - sec) < 1800 for a in acc)
        near_d = any(a[1] == d and a[2] == day and abs(a[3] - sec) < 1800 for a in acc)
        if near_p:
            out[seq] = (-1, "patient")
        elif near_d:
            out[seq] = (-1, "doctor")
        elif day < as_of:
            out[seq] = (None, "past_date")
        elif p not in patients:
            out[seq] = (None, "unknown_patient")
        elif d not in doctors:
            out[seq] = (None, "unknown_doctor")
        else:
            out[seq] = (0, None)
            acc.append((p, d, day, sec))
    return out


def _hms(sec):
    return f"{sec // 3600:02d}:{sec % 3600 // 60:02d}:{sec % 60:02d}"


def test_booking_matches_sequential_loop(spark):
    rng = random.Random(7)
    patients = [f"P{i:04d}" for i in range(25)]
    doctors = [f"D{i:04d}" for i in range(8)]
    days = [dt.date(2025, 7, d) for d in (1, 2, 3)]
    as_of = dt.date(2025, 7, 2)
    existing = []
    for i in range(40):
        existing.append((rng.choice(patients), rng.choice(doctors), rng.choice(days), rng.randrange(8 * 3600, 12 * 3600)))
    reqs = []
    seqs = rng.sample(range(10_000), 450)
    for k, seq in enumerate(seqs):
        doctor = "D0000" if k % 3 == 0 else rng.choice(doctors)  # one hot doctor: a third of all calls
        patient = rng.choice(patients + ["P9999"])
        if rng.random() < 0.03:
            doctor = "D9999"
        reqs.append((seq, patient, doctor, rng.choice(days), rng.randrange(8 * 3600, 12 * 3600)))
    expect = _sequential_booking(existing, reqs, set(patients), set(doctors), as_of)

    appt_rows = [(f"A{i + 1:04d}", p, d, "Dept", day, _hms(sec), "Scheduled")
                 for i, (p, d, day, sec) in enumerate(existing)]
    appts = spark.createDataFrame(appt_rows, S.APPOINTMENT)
    bills = spark.createDataFrame([], S.BILLING)
    pats = spark.createDataFrame([(p, p, dt.date(1980, 1, 1), "x", "x", "x", "x") for p in patients], S.PATIENT)
    docs = spark.createDataFrame([(d, d, "Dept", "x", "x") for d in doctors], S.DOCTOR)
    req_df = spark.createDataFrame([(s, p, d, day.isoformat(), _hms(sec), "Dept") for s, p, d, day, sec in reqs],
                                   S.BOOKING_REQUESTS)
    new_appts, new_bills, outcome = BK.book_appointments(appts, bills, pats, docs, req_df, as_of=as_of)
    got = {r["seq"]: (r["status"], r["reason"]) for r in outcome.collect()}
    assert got == expect

    booked = sorted(s for s, (st, _) in expect.items() if st == 0)
    ids = {r["seq"]: r["Appointment_ID"] for r in outcome.where("status = 0").collect()}
    assert [ids[s] for s in booked] == [f"A{len(existing) + i + 1:04d}" for i in range(len(booked))]
    assert new_appts.count() == len(existing) + len(booked)
    assert new_bills.count() == len(booked)


def test_slot_conflicts_counts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        rows.append((f"A{i:04d}", rng.choice(["P1", "P2", "P3"]), rng.choice(["D1", "D2"]), "Dept",
                     dt.date(2025, 7, rng.choice([1, 2])), _hms(rng.randrange(9 * 3600, 11 * 3600)), "Scheduled"))
    df = spark.createDataFrame(rows, S.APPOINTMENT)
    got = {r["Appointment_ID"]: (r["patient_conflicts"], r["doctor_conflicts"]) for r in BK.slot_conflicts(df).collect()}

    def sec(t):
        h, m, s = map(int, t.split(":"))
        return h * 3600 + m * 60 + s
    expect = {}
    for a in rows:
        pc = sum(1 for b in rows if b is not a and b[1] == a[1] and b[4] == a[4] and abs(sec(b[5]) - sec(a[5])) < 1800)
        dc = sum(1 for b in rows if b is not a and b[2] == a[2] and b[4] == a[4] and abs(sec(b[5]) - sec(a[5])) < 1800)
        if pc or dc:
            expect[a[0]] = (pc, dc)
    assert got == expect


def test_payments_match_sequential_loop(spark):
    rng = random.Random(11)
    bills = [(f"B{i:03d}", "P1", "x", dt.date(2025, 1, 1), Decimal(rng.randrange(100, 5000)), Decimal("0.00"),
              None, "Pending") for i in range(20)]
    pays = []
    for seq in rng.sample(range(100_000), 600):
        bill = "B000" if rng.random() < 0.34 else rng.choice([b[0] for b in bills] + ["B999"])  # one hot bill
        pays.append((seq, bill, f"{rng.randrange(1, 40000) / 100:.2f}"))
    state = {b[0]: [b[4], b[5], 1] for b in bills}
    expect = {}
    for seq, bill, amt in sorted(pays):
        if bill not in state:
            expect[seq] = (False, None, None, None)
            continue
        st = state[bill]
        st[1] = st[1] + Decimal(amt)
        st[2] += 1
        expect[seq] = (True, st[1], "Paid" if st[1] >= st[0] else "Pending", st[2])
    b_df = spark.createDataFrame(bills, S.BILLING)
    p_df = spark.createDataFrame([(*p, None) for p in pays], S.PAYMENTS)
    new_bills, out = C.apply_payments(b_df, p_df, use_version=True)
    got = {r["seq"]: (r["ok"], r["Amount_Paid"], r["Payment_Status"], r["version"]) for r in out.collect()}
    assert got == expect
    final = {r["Bill_ID"]: (r["Amount_Paid"], r["Payment_Status"], r["version"]) for r in new_bills.collect()}
    for b, (charged, paid, version) in state.items():
        status = ("Paid" if paid >= charged else "Pending") if version > 1 else "Pending"
        assert final[b] == (paid, status, version)


def test_global_rank_and_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["k1", "k2", "k3"]), seq, rng.randrange(1, 100)) for seq in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(5)
    ranked = {r["seq"]: r["rank"] for r in global_rank(df, ["seq"], "rank").collect()}
    assert [ranked[s] for s in sorted(ranked)] == list(range(1, len(rows) + 1))
    # bits=3 forces several chunk levels (order range 5000 needs 13 bits).
    got = running_sums(df, ["k"], "seq", {"cum": "v"}, bits=3, order_bits=13).toPandas().sort_values(["k", "seq"])
    pdf = pd.DataFrame(rows, columns=["k", "seq", "v"]).sort_values(["k", "seq"])
    pdf["cum"] = pdf.groupby("k")["v"].cumsum()
    assert got["cum"].tolist() == pdf["cum"].tolist()
    assert F is not None


def test_running_sums_hot_key_uses_chunks(spark):
    # One key with more rows than 2**bits.
    rows = [("hot", seq, seq % 7) for seq in range(0, 3000, 3)] + [("cold", seq, 1) for seq in range(1, 40, 3)]
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(4)
    got = running_sums(df, ["k"], "seq", {"cum": "v"}, bits=4, order_bits=12).toPandas().sort_values(["k", "seq"])
    pdf = pd.DataFrame(rows, columns=["k", "seq", "v"]).sort_values(["k", "seq"])
    pdf["cum"] = pdf.groupby("k")["v"].cumsum()
    assert got["cum"].tolist() == pdf["cum"].tolist()


def test_booking_dense_chains_match_sequential_loop(spark):
    # Many calls packed into one hour for few patients and doctors: long chains of
    # accept / reject / accept across both keys.
    rng = random.Random(23)
    patients = [f"P{i:04d}" for i in range(6)]
    doctors = [f"D{i:04d}" for i in range(3)]
    day = dt.date(2025, 7, 1)
    reqs = [(seq, rng.choice(patients), rng.choice(doctors), day, rng.randrange(9 * 3600, 10 * 3600 + 1800))
            for seq in rng.sample(range(1000), 300)]
    expect = _sequential_booking([], reqs, set(patients), set(doctors), dt.date(2000, 1, 1))
    appts = spark.createDataFrame([], S.APPOINTMENT)
    bills = spark.createDataFrame([], S.BILLING)
    pats = spark.createDataFrame([(p, p, dt.date(1980, 1, 1), "x", "x", "x", "x") for p in patients], S.PATIENT)
    docs = spark.createDataFrame([(d, d, "Dept", "x", "x") for d in doctors], S.DOCTOR)
    req_df = spark.createDataFrame([(s, p, d, x.isoformat(), _hms(sec), "Dept") for s, p, d, x, sec in reqs],
                                   S.BOOKING_REQUESTS)
    _, _, outcome = BK.book_appointments(appts, bills, pats, docs, req_df)
    got = {r["seq"]: (r["status"], r["reason"]) for r in outcome.collect()}
    assert got == expect
