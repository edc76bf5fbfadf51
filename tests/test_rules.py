"""Guards, limits and rules of the ordered changes, inserts and audits; rounds of booking."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from medledger.operators import booking as BK
from medledger.operators import changes as C
from medledger.operators import quality as Q
from medledger.operators import reports as R
from medledger.operators.ordering import running_sums
from medledger.session import ensure_checkpoint_dir, intermediate_tables
from medledger.sources import schemas as S
from medledger.sources.tables import _roots, append_rows, ensure_column, insert_each
from seed import seed_tables

DAY = dt.date(2025, 1, 1)


def _bills(spark, rows):
    return spark.createDataFrame([(b, "P1", "x", DAY, Decimal(ch), Decimal(paid), None, "Pending") for b, ch, paid in rows], S.BILLING)


@pytest.mark.parametrize("fold_rows", [C.FOLD_ROWS, 3, 1])
def test_payments_equal_a_sequential_loop_with_every_rule(spark, monkeypatch, fold_rows):
    monkeypatch.setattr(C, "FOLD_ROWS", fold_rows)
    r = random.Random(8)
    start = [("B0", "100", "0"), ("B1", "5000", "-20"), ("B2", "-1", "0"), ("B3", "99999999", "99999900"), ("B4", "50", "0")]
    pays = [(s, r.choice(["B0", "B1", "B2", "B3", "B4", "B9"]), str(r.choice([5, 30, 70, 99999999])),
             r.choice([None, None, 1, 2, 3, 5])) for s in r.sample(range(1000), 80)]
    state = {b: [Decimal(ch), Decimal(p), 1] for b, ch, p in start}
    want = {}
    for s, b, a, e in sorted(pays):
        if b not in state:
            want[s] = "not_found"
        elif e is not None and e != state[b][2]:
            want[s] = "version_conflict"
        elif state[b][0] < 0 or state[b][1] + Decimal(a) < 0:
            want[s] = "negative_amount"
        elif state[b][1] + Decimal(a) > Decimal("99999999.99"):
            want[s] = "out_of_range"
        else:
            state[b][1] += Decimal(a)
            state[b][2] += 1
            want[s] = (state[b][1], state[b][2])
    bills = ensure_column(_bills(spark, start), "version", "int", 1)
    new, out = C.apply_payments(bills, spark.createDataFrame(pays, S.PAYMENTS))
    got = {x["seq"]: x["reason"] or (x["Amount_Paid"], x["version"]) for x in out.collect()}
    assert got == want and {"not_found", "version_conflict", "negative_amount", "out_of_range"} <= {v for v in want.values() if isinstance(v, str)}
    assert {x["Bill_ID"]: (x["Amount_Paid"], x["version"]) for x in new.collect()} == {b: (s[1], s[2]) for b, s in state.items()}


@pytest.mark.parametrize("expecting", [0.9, 0.4])
def test_a_bill_with_a_third_of_all_guarded_payments(spark, monkeypatch, expecting):
    """Long chains: most calls know the version that the bill has, some are late, some race for the same one."""
    monkeypatch.setattr(C, "FOLD_ROWS", 16)
    r = random.Random(int(expecting * 10))
    start = [(f"B{k}", "100", "0" if k else "99999000") for k in range(4)]
    state = {b: [Decimal(p), 1] for b, _, p in start}
    pays, want = [], {}
    for s in range(700):
        b = "B0" if r.random() < 0.34 else r.choice(list(state))
        e = state[b][1] - r.choice([0, 0, 0, 1]) if r.random() < expecting else None
        a = Decimal(r.choice([1, 2, 9, 60, 400]))
        pays.append((3 * s, b, str(a), e))
        if e is not None and e != state[b][1]:
            want[3 * s] = "version_conflict"
        elif state[b][0] + a > Decimal("99999999.99"):
            want[3 * s] = "out_of_range"
        else:
            state[b] = [state[b][0] + a, state[b][1] + 1]
            want[3 * s] = tuple(state[b])
    r.shuffle(pays)
    _, out = C.apply_payments(ensure_column(_bills(spark, start), "version", "int", 1), spark.createDataFrame(pays, S.PAYMENTS))
    assert {x["seq"]: x["reason"] or (x["Amount_Paid"], x["version"]) for x in out.collect()} == want
    assert "out_of_range" in want.values() and "version_conflict" in want.values()


def test_guarded_payments_run_no_python(spark):
    bills = ensure_column(_bills(spark, [("B0", "10", "0")]), "version", "int", 1)
    _, out = C.apply_payments(bills, spark.createDataFrame([(1, "B0", "5", 1)], S.PAYMENTS))
    assert "Python" not in out._jdf.queryExecution().toString() and "Pandas" not in out._jdf.queryExecution().toString()


def test_version_is_bumped_where_the_table_has_it(spark):
    pays = spark.createDataFrame([(1, "B0", "5", None)], S.PAYMENTS)
    plain = _bills(spark, [("B0", "10", "0")])
    assert "version" not in C.apply_payments(plain, pays)[0].columns
    assert C.apply_payments(ensure_column(plain, "version", "int", 1), pays)[0].first()["version"] == 2


def test_repeated_seq_is_refused_everywhere(spark):
    t = seed_tables(spark)
    calls = [
        lambda: C.apply_payments(t["BILLING"], spark.createDataFrame([(1, "B6001", "5", None)] * 2, S.PAYMENTS)),
        lambda: C.apply_status_changes(t["APPOINTMENT"], t["BILLING"], spark.createDataFrame([(1, "A3001", "cancel")] * 2, S.STATUS_CHANGES)),
        lambda: C.update_lab_results(t["LABTEST"], spark.createDataFrame([(1, "L1", "x")] * 2, S.LAB_UPDATES)),
        lambda: BK.request_conflicts(t["APPOINTMENT"], spark.createDataFrame([(1, "P1", "D1", "2025-01-01", "10:00:00", "x")] * 2, S.BOOKING_REQUESTS)),
    ]
    for call in calls:
        with pytest.raises(ValueError, match="unique seq"):
            call()


def test_update_rule_holds_for_status_changes_and_updates(spark):
    appts = spark.createDataFrame([("A1", "P1", "D1", "x", DAY, "10:00:00", "Scheduled")], S.APPOINTMENT)
    change = spark.createDataFrame([(1, "A1", "complete")], S.STATUS_CHANGES)
    for charged, ok in (("-1.00", False), ("1.00", True)):
        bills = _bills(spark, [("B1", charged, "0"), ("B2", "7", "0")])
        a, b, out = C.apply_status_changes(appts, bills, change)
        row = out.first()
        assert (row["ok"], row["reason"]) == (ok, None if ok else "negative_amount")
        assert a.first()["Status"] == ("Completed" if ok else "Scheduled")
        assert {x["Payment_Status"] for x in b.collect()} == {"Processing" if ok else "Pending"}
    bills = _bills(spark, [("B1", "-1", "0"), ("B2", "7", "0")])
    fine = C.update_where(bills, F.col("Bill_ID") == "B2", {"Payment_Status": "Void"}, Q.billing_rules())
    assert fine.where("Payment_Status = 'Void'").count() == 1 and fine.columns == bills.columns
    with pytest.raises(Exception, match="Negative billing amounts"):
        C.update_where(bills, F.lit(True), {"Payment_Status": "Void"}, Q.billing_rules()).collect()


def test_insert_rules(spark):
    t = seed_tables(spark)
    bills = ensure_column(t["BILLING"], "version", "int", 1)
    row = {"Bill_ID": "B7", "Patient_ID": "P1001", "Service_Type": "x", "Service_Date": DAY, "Amount_Charged": Decimal(1),
           "Amount_Paid": Decimal(0), "Payment_Status": "Pending"}
    added = append_rows(bills, [row], "BILLING", Q.billing_rules()).where("Bill_ID = 'B7'").first()
    assert added["version"] == 1 and added["Payment_Date"] is None
    with pytest.raises(ValueError, match="Payment_Status"):
        append_rows(bills, [{k: v for k, v in row.items() if k != "Payment_Status"}], "BILLING")
    with pytest.raises(Exception, match="Patient_ID.*cannot be null"):
        append_rows(bills, [row | {"Patient_ID": None}], "BILLING").collect()
    with pytest.raises(Exception, match="Negative billing amounts"):
        append_rows(bills, [row | {"Amount_Paid": Decimal(-1)}], "BILLING", Q.billing_rules()).collect()
    late = ("A9", "P1001", "D2001", "x", DAY, "10:00:00", "Scheduled")
    with pytest.raises(Exception, match="in the past"):
        append_rows(t["APPOINTMENT"], [late], "APPOINTMENT", Q.appointment_date_rules("2025-01-02")).collect()
    assert append_rows(t["APPOINTMENT"], [late], "APPOINTMENT", Q.appointment_date_rules("2025-01-01")).count() == 2


def test_audits_report_violations(spark):
    child = spark.createDataFrame([("c1", "p1"), ("c2", "p9"), ("c3", None), ("c3", "p9"), (None, "p1")], "k string, ref string")
    parent = spark.createDataFrame([("p1",), (None,)], "id string")
    got = Q.audit_foreign_key(child, "ref", parent, "id", "k", "T").collect()
    assert sorted((r["key"], r["detail"]) for r in got) == [("c2", "p9"), ("c3", "p9")]
    got = Q.audit_primary_key(child, "k", "T").collect()
    assert sorted((r["rule"], str(r["key"]), r["detail"]) for r in got) == [
        ("primary_key_duplicate", "c3", "2 rows"), ("primary_key_null", "None", "1 rows")]
    money = spark.createDataFrame([("a", Decimal("99999999.99")), ("b", Decimal("100000000.00")), ("c", None)], "k string, m decimal(14,2)")
    assert [r["key"] for r in Q.audit_decimals(money, ["m"], "k").collect()] == ["b"]
    assert [r["null_rows"] for r in Q.audit_not_null(money, ["m"]).collect()] == [1]


def test_delete_by_prefix_keeps_null(spark):
    df = spark.createDataFrame([("TEST-1",), ("X",), (None,)], "k string")
    assert [r["k"] for r in C.delete_where(df, F.col("k").like("TEST%")).orderBy("k").collect()] == [None, "X"]


@pytest.mark.parametrize("bits", [2, 16])
def test_running_sums_keep_null_keys(spark, bits):
    rows = [(None if s % 5 == 0 else "k", s, s % 7) for s in range(22)]
    got = running_sums(spark.createDataFrame(rows, "k string, seq long, v long"), ["k"], "seq", {"c": "v"}, bits=bits, order_bits=6)
    want, total = [], {}
    for k, s, v in rows:
        total[k] = total.get(k, 0) + v
        want.append((k, s, total[k]))
    assert sorted(((r["k"], r["seq"], r["c"]) for r in got.collect()), key=lambda x: x[1]) == want


def _book(spark, calls, **options):
    names = lambda at: sorted({c[at] for c in calls})
    pats = spark.createDataFrame([(p, p, DAY, "x", "x", "x", "x") for p in names(1)], S.PATIENT)
    docs = spark.createDataFrame([(d, d, "Dept", "x", "x") for d in names(2)], S.DOCTOR)
    clock = lambda m: f"{m // 60:02d}:{m % 60:02d}:00"
    reqs = spark.createDataFrame([(s, p, d, "2025-07-01", clock(m), "Dept") for s, p, d, m in calls], S.BOOKING_REQUESTS)
    empty = spark.createDataFrame([], S.APPOINTMENT), spark.createDataFrame([], S.BILLING)
    rounds: list[int] = []
    out = BK.book_new_rows(*empty, pats, docs, reqs, rounds=rounds, **options)
    return {r["seq"]: r["status"] for r in out[2].collect()}, rounds[0]


def test_a_day_of_one_doctor_settles_in_one_round(spark):
    got, rounds = _book(spark, [(i, f"P{i}", "D1", 20 * i) for i in range(72)])
    assert rounds <= 3 and [got[i] for i in range(72)] == [0 if i % 2 == 0 else -1 for i in range(72)]


def test_a_hopping_chain_takes_a_round_per_two_links(spark):
    """Each call shares its patient with the one before and its doctor with the one after: doubly contested."""
    calls = [(i, f"P{(i + 1) // 2}", f"D{i // 2}", 600) for i in range(12)]
    got, rounds = _book(spark, calls)
    assert [got[i] for i in range(12)] == [0 if i % 2 == 0 else -1 for i in range(12)]
    assert rounds <= 7


def test_a_long_hopping_chain_is_settled_by_doubling(spark):
    """64 doubly contested links, a branch off the chain and a call with two earlier neighbours."""
    calls = [(i, f"P{(i + 1) // 2}", f"D{i // 2}", 600) for i in range(64)]
    calls += [(100, "P100", "D31", 615), (101, "P100", "D200", 630), (102, "P7", "D14", 600), (103, "P101", "D200", 650)]
    taken, want = [], {}
    for s, p, d, m in calls:
        busy = any(abs(m - n) < 30 and (p == q or d == e) for q, e, n in taken)
        want[s] = -1 if busy else 0
        taken += [] if busy else [(p, d, m)]
    got, rounds = _book(spark, calls)
    assert got == want and rounds <= 4


def test_columns_that_old_rows_lack_take_their_defaults(spark):
    old = spark.createDataFrame([("A1",)], "Appointment_ID string")
    new = spark.createDataFrame([("A2", "Heart", 3)], "Appointment_ID string, Department string, version int")
    assert sorted(tuple(r) for r in BK._append(old, new).collect()) == [("A1", None, 1), ("A2", "Heart", 3)]


def test_intermediate_tables_are_removed(spark):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark) + "/medledger-tables")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = lambda: len(files.listStatus(root)) if files.exists(root) else 0
    before = count()
    with intermediate_tables(spark):
        got, _ = _book(spark, [(1, "P1", "D1", 600), (2, "P2", "D1", 610)])
        assert count() > before
    assert got == {1: 0, 2: -1} and count() == before


def test_report_order(spark):
    doctors = spark.createDataFrame([(f"D{i}", f"n{i}", "x", "x", "x") for i in range(3)], S.DOCTOR)
    appts = spark.createDataFrame([(f"A{i}", "P1", f"D{d}", "x", dt.date(2025, 1, day), t, s) for i, (d, day, t, s) in enumerate([
        (1, 9, "09:00:00", "Completed"), (1, 2, "11:00:00", "Scheduled"), (1, 2, "08:00:00", "Canceled"), (0, 5, "10:00:00", "Completed")])], S.APPOINTMENT)
    assert [(r["Doctor_ID"], r["Total_Appointments"], r["Completed_Appointments"]) for r in R.doctor_appointment_stats(doctors, appts).collect()] == [
        ("D1", 3, 1), ("D0", 1, 1), ("D2", 0, 0)]
    assert [r["Appointment_ID"] for r in R.patient_appointment_history(appts, doctors, "P1").collect()] == ["A2", "A1", "A3", "A0"]
    rx = spark.createDataFrame([(f"R{i}", "P1", "D1", dt.date(2025, 1, d), "m", "d", "f") for i, d in enumerate([7, 3, 9, 5])], S.PRESCRIPTION)
    assert [r["Prescription_ID"] for r in R.prescriptions_between(rx, doctors, "2025-01-03", "2025-01-07").collect()] == ["R1", "R3", "R0"]


def test_rows_inserted_one_by_one(spark):
    t = seed_tables(spark)
    row = lambda k, key, patient="P1001", text="x", charged="1": (k, key, patient, text, DAY, charged and Decimal(charged), Decimal(0), None, "Pending")
    calls = [row(1, "B6001"), row(2, "N1", charged="-1"), row(3, "N1"), row(4, "N1"), row(5, "N2", patient="P0"), row(6, "N2", text="y" * 101),
             row(7, None), row(8, "N2", charged=None), row(9, "N2"), row(10, "N3", patient=None)]
    new = spark.createDataFrame(calls, "call int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.BILLING.fields))
    table, outcome = insert_each(t["BILLING"], new, "BILLING", "call", Q.billing_rules(), t)
    assert {r["call"]: r["rule"] for r in outcome.collect()} == {
        1: "duplicate_key", 2: "negative_amount", 3: None, 4: "duplicate_key", 5: "foreign_key", 6: "too_long", 7: "not_null",
        8: "not_null", 9: None, 10: "not_null"}
    assert sorted(r["Bill_ID"] for r in table.collect()) == ["B6001", "N1", "N2"]
    with pytest.raises(ValueError, match="need a value"):
        insert_each(t["BILLING"], new.drop("Service_Type"), "BILLING", "call")
    with pytest.raises(ValueError, match="8 columns are needed"):
        append_rows(t["BILLING"], new, "BILLING", positional=True)


def test_booking_passes_many_days_in_several_tasks(spark, monkeypatch):
    """Contested days are dealt to tasks by their number; calls without others in reach take no part in the rounds."""
    monkeypatch.setattr(BK, "ROWS_PER_PASS", 8)
    seen, decide = [], BK._decide
    monkeypatch.setattr(BK, "_decide", lambda alive, minutes: (seen.append(alive.count()), decide(alive, minutes))[1])
    rng = random.Random(5)
    calls = [(i, f"P{rng.randrange(12)}", f"D{rng.randrange(6)}", rng.randrange(1400)) for i in range(60)]
    calls += [(100 + i, f"Q{i}", f"E{i}", 700) for i in range(20)]
    taken, want = [], {}
    for s, p, d, m in calls:
        busy = any(abs(m - n) < 30 and (p == q or d == e) for q, e, n in taken)
        want[s] = -1 if busy else 0
        taken += [] if busy else [(p, d, m)]
    got, _ = _book(spark, calls)
    assert got == want and 0 < seen[0] <= 60


def test_plain_payments_are_cut_up_only_for_crowded_bills(spark, monkeypatch):
    """A bill's running sums take one window; one with a crowd of payments is cut into chunks, with the same outcome."""
    bill = lambda i: (f"B{i}", "P1", "x", DAY, Decimal("500.00"), Decimal("0.00"), None, "Pending")
    bills = spark.createDataFrame([bill(i) for i in range(3)], S.BILLING)
    calls = [(s, None if s == 5 else f"B{s % 2 if s % 7 else 9}", f"{s + 1}.50") for s in range(30)]
    pays = spark.createDataFrame(calls, "seq bigint, Bill_ID string, amount string")

    def run():
        cut = []
        sums = C.running_sums
        monkeypatch.setattr(C, "running_sums", lambda *a, **k: (cut.append(1), sums(*a, **k))[1])
        new, outcome = C.apply_payments(bills, pays)
        got = sorted(tuple(r) for r in new.collect()), sorted((tuple(r) for r in outcome.collect()), key=lambda r: r[0])
        monkeypatch.setattr(C, "running_sums", sums)
        return got, len(cut)

    got, cut = run()
    monkeypatch.setattr(C, "WINDOW_ROWS", 3)
    again, cut_again = run()
    assert got == again and (cut, cut_again) == (0, 1)
    left = {}
    for (s, b, amount), r in zip(calls, got[1], strict=True):
        ok = b in ("B0", "B1")
        left[b] = left.get(b, 0) + (Decimal(amount) if ok else 0)
        assert (r[3], r[7], r[4]) == ((True, None, left[b]) if ok else (False, "not_found", None))


def _calls_into_a_book(spark, path):
    """60 random calls (some past, unknown or faulty) into a stored book, and what a loop over them gives."""
    rng = random.Random(11)
    text = lambda m: f"{m // 60}:{m % 60}:0"
    book = [(f"P{rng.randrange(8)}", f"D{rng.randrange(5)}", rng.randrange(900)) for _ in range(25)]
    spark.createDataFrame([(f"A{i:04d}", p, d, "Dept", dt.date(2025, 7, 1), f"{m // 60:02d}:{m % 60:02d}:00", "Scheduled")
                           for i, (p, d, m) in enumerate(book)], S.APPOINTMENT).write.parquet(path)
    pats = spark.createDataFrame([(f"P{i}", "x", DAY, "x", "x", "x", "x") for i in range(8)], S.PATIENT)
    docs = spark.createDataFrame([(f"D{i}", "x", "Dept", "x", "x") for i in range(5)], S.DOCTOR)
    calls, want, top = [], {}, 24
    taken = [("2025-07-01", *b) for b in book]
    for seq in range(60):
        p, d, m = f"P{rng.randrange(10)}", f"D{rng.randrange(6)}", rng.randrange(900)
        day, time = rng.choice(["2025-07-01", "2025-07-01", "2025-06-01"]), "25:0:0" if seq % 13 == 5 else text(m)
        calls.append((seq, f" {p} ", d, day, time, "Dept"))
        near = [(q, e) for on, q, e, n in taken if on == day and abs(n - m) < 30]
        if seq % 13 == 5:
            want[seq] = (f" {p} ", "25:0:0", None, "invalid_request", None)
            continue
        if any(q == p for q, _ in near):
            status, reason = -1, "patient"
        elif any(e == d for _, e in near):
            status, reason = -2, "doctor"
        else:
            reason = ("past_date" if day < "2025-06-15" else "unknown_patient" if p in ("P8", "P9") else "unknown_doctor" if d == "D5" else None)
            status = None if reason else 0
        if status == 0:
            taken.append((day, p, d, m))
            top += 1
        want[seq] = (p, f"{m // 60:02d}:{m % 60:02d}:00", status, reason, f"A{top:04d}" if status == 0 else None)
    return pats, docs, spark.createDataFrame(calls, S.BOOKING_REQUESTS), want


def _book_into(spark, tmp_path):
    path = str(tmp_path / "book")
    pats, docs, reqs, want = _calls_into_a_book(spark, path)
    out = BK.book_new_rows(spark.read.parquet(path), spark.createDataFrame([], S.BILLING), pats, docs, reqs,
                           as_of="2025-06-15", distinct_codes=True)
    got = {r["seq"]: (r["Patient_ID"], r["Appointment_Time"], r["status"], r["reason"], r["Appointment_ID"]) for r in out[2].collect()}
    return got, want


def test_booking_reads_the_book_once_for_both_keys(spark, monkeypatch, tmp_path):
    reads, cut = [], BK.cut_lineage
    monkeypatch.setattr(BK, "cut_lineage", lambda df: (reads.extend(r for r in _roots(df) if r.endswith("/book")), cut(df))[1])
    got, want = _book_into(spark, tmp_path)
    assert got == want and len(reads) == 1


def test_booking_stores_a_batch_of_calls_once_and_checked(spark, monkeypatch, tmp_path):
    """Texts of calls are stored when checked, with the flags of the rounds left out of the rows that are ranked."""
    stored, ranked, cut, rank = [], [], BK.cut_lineage, BK.global_rank
    note = lambda df: (stored.append(df.columns), cut(df))[1]
    monkeypatch.setattr(BK, "cut_lineage", note)
    monkeypatch.setattr("medledger.operators.ordering.cut_lineage", note)
    monkeypatch.setattr(BK, "global_rank", lambda df, *a: (ranked.append(set(df.columns)), rank(df, *a))[1])
    got, want = _book_into(spark, tmp_path)
    assert got == want and sum("Appointment_Time" in columns for columns in stored) == 1
    assert ranked == [{"seq", "Patient_ID", "Doctor_ID", "_date", "_sec", "Department"}]


def test_booking_of_a_busy_patient_needs_no_second_look(spark, monkeypatch, tmp_path):
    looked, look = [], BK._earlier_conflict
    monkeypatch.setattr(BK, "_earlier_conflict", lambda req, *a: (looked.append(req.where("_busy0").count()), look(req, *a))[1])
    got, want = _book_into(spark, tmp_path)
    assert got == want and looked == [0]


def test_reach_ends_at_thirty_minutes_and_midnight(spark, tmp_path):
    """Seconds without another in reach are left out of the windows; those at its very end are not."""
    path, day = str(tmp_path / "book"), dt.date(2025, 7, 1)
    book = [("P1", "D9", "10:00:00"), ("P2", "D9", "23:59:59"), ("P3", "D9", "04:00:00"), ("P3", "D9", "04:00:00")]
    spark.createDataFrame([(f"A{i}", p, d, "Dept", day, at, "Scheduled") for i, (p, d, at) in enumerate(book)], S.APPOINTMENT).write.parquet(path)
    calls = [("P1", "D1", "2025-07-01", "10:30:00", 0), ("P1", "D1", "2025-07-01", "09:30:01", -1), ("P1", "D2", "2025-07-01", "11:00:00", 0),
             ("P2", "D3", "2025-07-02", "0:0:0", 0), ("P2", "D4", "2025-07-01", "23:59:59", -1), ("P3", "D5", "2025-07-01", "04:00:00", -1),
             ("P4", "D6", "2025-07-01", "12:00:00", 0), ("P5", "D6", "2025-07-01", "12:00:00", -2), ("P6", "D6", "2025-07-01", "12:30:00", 0)]
    pats = spark.createDataFrame([(f"P{i}", "x", DAY, "x", "x", "x", "x") for i in range(1, 7)], S.PATIENT)
    docs = spark.createDataFrame([(f"D{i}", "x", "Dept", "x", "x") for i in range(1, 7)], S.DOCTOR)
    reqs = spark.createDataFrame([(i, *c[:4], "Dept") for i, c in enumerate(calls)], S.BOOKING_REQUESTS)
    out = BK.book_new_rows(spark.read.parquet(path), spark.createDataFrame([], S.BILLING), pats, docs, reqs, distinct_codes=True)[2]
    assert {r["seq"]: r["status"] for r in out.collect()} == {i: c[4] for i, c in enumerate(calls)}
