"""Named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name]`` builds the Spark DataFrame from (spark, sf_dir);
``ORACLES[name]`` is the equivalent SQL over the driver tables, with the
fixture mapping inlined as CTEs.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from medledger.operators import reports as R
from medledger.sources.fixture_sql import with_views
from medledger.sources.fixtures import Fixture

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
_ORACLE_TEXT: dict[str, str] = {}  # before the fixture CTEs are inlined

# Parameters of the report queries on the driver data (the reference's own
# constants name rows that the mapped data does not contain).
REPORT_PATIENT = "P00000007"
LAB_CUTOFF = "1998-06-20"
RX_FROM, RX_TO = "1998-06-15", "1998-06-25"


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        if oracle is not None:
            _ORACLE_TEXT[name] = oracle
            ORACLES[name] = with_views(oracle)
        return fn
    return deco


# ---------------------------------------------------------------- reports

@register("row_counts", """
select 'PATIENT' Table_Name, count(*) Record_Count from PATIENT
union all select 'DOCTOR', count(*) from DOCTOR
union all select 'APPOINTMENT', count(*) from APPOINTMENT
union all select 'LABTEST', count(*) from LABTEST
union all select 'PRESCRIPTION', count(*) from PRESCRIPTION
union all select 'BILLING', count(*) from BILLING""")
def _row_counts(fx: Fixture) -> DataFrame:
    return R.row_counts(fx.tables())


@register("lookup_pending_bills", """
select * from BILLING where Payment_Status = 'Pending'""")
def _lookup_pending(fx: Fixture) -> DataFrame:
    return R.lookup(fx.BILLING, "Payment_Status", "Pending")


@register("lookup_patient", f"""
select * from PATIENT where Patient_ID = '{REPORT_PATIENT}'""")
def _lookup_patient(fx: Fixture) -> DataFrame:
    return R.lookup(fx.PATIENT, "Patient_ID", REPORT_PATIENT)


@register("lookup_patient_appointments", f"""
select * from APPOINTMENT where Patient_ID = '{REPORT_PATIENT}'""")
def _lookup_patient_appts(fx: Fixture) -> DataFrame:
    return R.lookup(fx.APPOINTMENT, "Patient_ID", REPORT_PATIENT)


@register("patient_appointment_history", f"""
select a.Appointment_ID, a.Appointment_Date, a.Appointment_Time, a.Department, a.Status, d.Full_Name Doctor_Name
from APPOINTMENT a join DOCTOR d on a.Doctor_ID = d.Doctor_ID
where a.Patient_ID = '{REPORT_PATIENT}' order by a.Appointment_Date, a.Appointment_Time""")
def _history(fx: Fixture) -> DataFrame:
    return R.patient_appointment_history(fx.APPOINTMENT, fx.DOCTOR, REPORT_PATIENT)


@register("outstanding_bills", """
select p.Patient_ID, p.Full_Name, cast(sum(b.Amount_Charged - b.Amount_Paid) as decimal(21,2)) Total_Outstanding
from PATIENT p join BILLING b on p.Patient_ID = b.Patient_ID
where b.Payment_Status = 'Pending' group by p.Patient_ID, p.Full_Name having Total_Outstanding > 0""")
def _outstanding(fx: Fixture) -> DataFrame:
    return R.outstanding_bills(fx.PATIENT, fx.BILLING)


@register("outstanding_by_patient", """
select Patient_ID, cast(sum(Amount_Charged - Amount_Paid) as decimal(21,2)) Total_Outstanding
from BILLING where Payment_Status = 'Pending' group by Patient_ID""")
def _outstanding_by_patient(fx: Fixture) -> DataFrame:
    return R.outstanding_by_patient(fx.BILLING)


@register("pending_lab_tests_before", f"""
select Lab_Order_ID, Patient_ID, Test_Type, Scheduled_Date from LABTEST
where Result = 'Pending' and Scheduled_Date < date '{LAB_CUTOFF}'""")
def _pending_labs(fx: Fixture) -> DataFrame:
    return R.pending_lab_tests_before(fx.LABTEST, LAB_CUTOFF)


@register("prescriptions_between", f"""
select pr.Prescription_ID, pr.Patient_ID, d.Full_Name Doctor_Name, pr.Medication_Name, pr.Dosage, pr.Date_Issued
from PRESCRIPTION pr join DOCTOR d on pr.Doctor_ID = d.Doctor_ID
where pr.Date_Issued between date '{RX_FROM}' and date '{RX_TO}' order by pr.Date_Issued""")
def _prescriptions(fx: Fixture) -> DataFrame:
    return R.prescriptions_between(fx.PRESCRIPTION, fx.DOCTOR, RX_FROM, RX_TO)


@register("doctor_appointment_stats", """
select d.Doctor_ID, d.Full_Name, cast(count(a.Appointment_ID) as bigint) Total_Appointments,
 cast(sum(case when a.Status = 'Completed' then 1 else 0 end) as bigint) Completed_Appointments
from DOCTOR d left join APPOINTMENT a on d.Doctor_ID = a.Doctor_ID
group by d.Doctor_ID, d.Full_Name order by Total_Appointments desc""")
def _doctor_stats(fx: Fixture) -> DataFrame:
    return R.doctor_appointment_stats(fx.DOCTOR, fx.APPOINTMENT)


@register("doctor_appointment_counts", """
select d.Doctor_ID, cast(count(a.Appointment_ID) as bigint) Total_Appointments
from DOCTOR d left join APPOINTMENT a on d.Doctor_ID = a.Doctor_ID group by d.Doctor_ID""")
def _doctor_counts(fx: Fixture) -> DataFrame:
    return R.doctor_appointment_counts(fx.DOCTOR, fx.APPOINTMENT)


@register("outstanding_bill_per_patient", """
select p.Patient_ID, cast(coalesce((select sum(b.Amount_Charged - b.Amount_Paid) from BILLING b
  where b.Patient_ID = p.Patient_ID and b.Payment_Status = 'Pending'), 0.00) as decimal(10,2)) Outstanding_Bill
from PATIENT p""")
def _outstanding_bill(fx: Fixture) -> DataFrame:
    return R.outstanding_bill(fx.PATIENT, fx.BILLING)


@register("patient_report", """
select Patient_ID, 'appointments' section, Appointment_ID record_id, Appointment_Date event_date,
 Appointment_Time event_time, Department item, Status status, cast(null as decimal(10,2)) Amount_Charged,
 cast(null as decimal(10,2)) Amount_Paid, cast(null as decimal(11,2)) Balance from APPOINTMENT
union all
select Patient_ID, 'lab_tests', Lab_Order_ID, Scheduled_Date, cast(null as string), Test_Type, Result,
 null, null, null from LABTEST
union all
select Patient_ID, 'billing', Bill_ID, Service_Date, cast(null as string), Service_Type, Payment_Status,
 Amount_Charged, Amount_Paid, cast(Amount_Charged - Amount_Paid as decimal(11,2)) from BILLING""")
def _patient_report(fx: Fixture) -> DataFrame:
    return R.patient_report(fx.APPOINTMENT, fx.LABTEST, fx.BILLING)


@register("patient_report_positions", """
with rows as (
 select Patient_ID, 'appointments' section, 1 sec_order, Appointment_ID record_id, Appointment_Date event_date,
  Appointment_Time event_time, Department item, Status status, cast(null as decimal(10,2)) Amount_Charged,
  cast(null as decimal(10,2)) Amount_Paid, cast(null as decimal(11,2)) Balance from APPOINTMENT
 union all
 select Patient_ID, 'lab_tests', 2, Lab_Order_ID, Scheduled_Date, cast(null as string), Test_Type, Result,
  null, null, null from LABTEST
 union all
 select Patient_ID, 'billing', 3, Bill_ID, Service_Date, cast(null as string), Service_Type, Payment_Status,
  Amount_Charged, Amount_Paid, cast(Amount_Charged - Amount_Paid as decimal(11,2)) from BILLING)
select Patient_ID, section, record_id, event_date, event_time, item, status, Amount_Charged, Amount_Paid, Balance,
 cast(row_number() over (partition by Patient_ID, section
   order by event_date desc, event_time desc nulls last, record_id) as bigint) pos
from rows""")
def _patient_report_pos(fx: Fixture) -> DataFrame:
    return R.patient_report(fx.APPOINTMENT, fx.LABTEST, fx.BILLING, with_positions=True)


# ---------------------------------------------------------------- quality

from medledger.functions.columns import DATE_PATTERN, TIME_PATTERN  # noqa: E402
from medledger.operators import quality as Q  # noqa: E402
from medledger.sources import schemas as SC  # noqa: E402

AUDIT_TABLES = ["PATIENT", "DOCTOR", "APPOINTMENT", "LABTEST", "PRESCRIPTION", "BILLING"]
AS_OF = "2024-01-15"


def _fixture_columns(table: str) -> list[str]:
    # Columns the fixture mapping provides (see fixture_sql.VIEWS); fixed by the mapping.
    return {
        "PATIENT": ["Patient_ID", "Full_Name"],
        "DOCTOR": ["Doctor_ID", "Full_Name", "Department"],
        "APPOINTMENT": ["Appointment_ID", "Patient_ID", "Doctor_ID", "Department", "Appointment_Date",
                        "Appointment_Time", "Status"],
        "LABTEST": ["Lab_Order_ID", "Patient_ID", "Test_Type", "Order_Date", "Scheduled_Date", "Result"],
        "PRESCRIPTION": ["Prescription_ID", "Patient_ID", "Doctor_ID", "Date_Issued", "Medication_Name", "Dosage"],
        "BILLING": ["Bill_ID", "Patient_ID", "Service_Type", "Service_Date", "Amount_Charged", "Amount_Paid",
                    "Payment_Date", "Payment_Status"],
    }[table]


def _pk_sql() -> str:
    parts = []
    for t in AUDIT_TABLES:
        k = SC.PRIMARY_KEYS[t]
        parts.append(f"select 'primary_key_duplicate' rule, '{t}' table_name, '{k}' column_name, cast({k} as string) key,"
                     f" cast(count(*) as string)||' rows' detail from {t} where {k} is not null"
                     f" group by {k} having count(*) > 1")
        parts.append(f"select 'primary_key_null', '{t}', '{k}', cast(null as string),"
                     f" cast(count(*) as string)||' rows' from {t} where {k} is null having count(*) > 0")
    return "\nunion all\n".join(parts)


@register("audit_primary_keys", _pk_sql())
def _audit_pk(fx: Fixture) -> DataFrame:
    parts = [Q.audit_primary_key(getattr(fx, t), SC.PRIMARY_KEYS[t], t) for t in AUDIT_TABLES]
    return reduce(DataFrame.unionAll, parts)


def _fk_sql() -> str:
    parts = []
    for child, col, parent, pk in SC.FOREIGN_KEYS:
        ck = SC.PRIMARY_KEYS[child]
        parts.append(f"select 'foreign_key' rule, '{child}' table_name, '{col}' column_name, cast(c.{ck} as string) key,"
                     f" cast(c.{col} as string) detail from {child} c where c.{col} is not null and not exists"
                     f" (select 1 from {parent} p where p.{pk} = c.{col})")
    return "\nunion all\n".join(parts)


@register("audit_foreign_keys", _fk_sql())
def _audit_fk(fx: Fixture) -> DataFrame:
    parts = [Q.audit_foreign_key(getattr(fx, child), col, getattr(fx, parent), pk, SC.PRIMARY_KEYS[child], child)
             for child, col, parent, pk in SC.FOREIGN_KEYS]
    return reduce(DataFrame.unionAll, parts)


def _nn_columns(t: str) -> list[str]:
    return [c for c in SC.not_null_columns(t) if c in _fixture_columns(t)]


def _nn_sql() -> str:
    return "\nunion all\n".join(
        f"select 'not_null' rule, '{t}' table_name, '{c}' column_name, cast(count(*) - count({c}) as bigint) null_rows"
        f" from {t}" for t in AUDIT_TABLES for c in _nn_columns(t))


@register("audit_not_null", _nn_sql())
def _audit_nn(fx: Fixture) -> DataFrame:
    return reduce(DataFrame.unionAll, [Q.audit_not_null(getattr(fx, t), _nn_columns(t), t) for t in AUDIT_TABLES])


def _len_limits(t: str) -> dict[str, int]:
    return {c: n for c, n in SC.LENGTH_LIMITS[t].items() if c in _fixture_columns(t)}


def _len_sql() -> str:
    return "\nunion all\n".join(
        f"select 'length' rule, '{t}' table_name, '{c}' column_name, cast({SC.PRIMARY_KEYS[t]} as string) key,"
        f" cast(length({c}) as string)||' > {n}' detail from {t} where length({c}) > {n}"
        for t in AUDIT_TABLES for c, n in _len_limits(t).items())


@register("audit_lengths", _len_sql())
def _audit_len(fx: Fixture) -> DataFrame:
    return reduce(DataFrame.unionAll, [Q.audit_lengths(getattr(fx, t), _len_limits(t), SC.PRIMARY_KEYS[t], t)
                                       for t in AUDIT_TABLES])


@register("audit_decimal_ranges", """
select 'decimal_range' rule, 'BILLING' table_name, 'o_totalprice' column_name,
 concat('B',lpad(cast(o_orderkey as string),8,'0')) key, cast(o_totalprice as string) detail
from orders where o_totalprice is not null and try_cast(o_totalprice as decimal(10,2)) is null
union all
select 'decimal_range', 'ACCOUNT_BILLING', 'c_acctbal', concat('C',lpad(cast(c_custkey as string),8,'0')),
 cast(c_acctbal as string) from customer where c_acctbal is not null and try_cast(c_acctbal as decimal(10,2)) is null""")
def _audit_decimals(fx: Fixture) -> DataFrame:
    from medledger.sources.fixtures import key_id
    o = fx.raw("orders").withColumn("Bill_ID", key_id("B", "o_orderkey"))
    c = fx.raw("customer").withColumn("Bill_ID", key_id("C", "c_custkey"))
    return Q.audit_decimals(o, ["o_totalprice"], "Bill_ID", table="BILLING").unionAll(
        Q.audit_decimals(c, ["c_acctbal"], "Bill_ID", table="ACCOUNT_BILLING"))


# The same audits over tables that have every declared column and hold faults.

def _faulty(sql: str) -> str:
    return reduce(lambda q, t: re.sub(rf"\bfrom {t}\b", f"from FAULTY_{t}", q), AUDIT_TABLES, sql)


@register("audit_foreign_keys_faulty", "\nunion all\n".join(
    f"select 'foreign_key' rule, '{child}' table_name, '{col}' column_name, c.{SC.PRIMARY_KEYS[child]} key, c.{col} detail"
    f" from FAULTY_{child} c where c.{col} is not null and not exists (select 1 from {parent} p where p.{pk} = c.{col})"
    for child, col, parent, pk in SC.FOREIGN_KEYS))
def _audit_fk_faulty(fx: Fixture) -> DataFrame:
    return reduce(DataFrame.unionAll, [
        Q.audit_foreign_key(fx.FAULTY[child], col, getattr(fx, parent), pk, SC.PRIMARY_KEYS[child], child)
        for child, col, parent, pk in SC.FOREIGN_KEYS])


@register("audit_not_null_faulty", _faulty("\nunion all\n".join(
    f"select 'not_null' rule, '{t}' table_name, '{c}' column_name, cast(count(*) - count({c}) as bigint) null_rows from {t}"
    for t in AUDIT_TABLES for c in SC.not_null_columns(t))))
def _audit_nn_faulty(fx: Fixture) -> DataFrame:
    return reduce(DataFrame.unionAll, [Q.audit_not_null(fx.FAULTY[t], SC.not_null_columns(t), t) for t in AUDIT_TABLES])


@register("audit_lengths_faulty", _faulty("\nunion all\n".join(
    f"select 'length' rule, '{t}' table_name, '{c}' column_name, cast({SC.PRIMARY_KEYS[t]} as string) key,"
    f" cast(length({c}) as string)||' > {n}' detail from {t} where length({c}) > {n}"
    for t in AUDIT_TABLES for c, n in SC.LENGTH_LIMITS[t].items())))
def _audit_len_faulty(fx: Fixture) -> DataFrame:
    return reduce(DataFrame.unionAll, [Q.audit_lengths(fx.FAULTY[t], SC.LENGTH_LIMITS[t], SC.PRIMARY_KEYS[t], t)
                                       for t in AUDIT_TABLES])


@register("audit_decimals_faulty", "\nunion all\n".join(
    f"select 'decimal_range' rule, '{t}' table_name, '{c}' column_name, {SC.PRIMARY_KEYS[t]} key, cast({c} as string) detail"
    f" from FAULTY_{t} where {c} is not null and try_cast({c} as decimal(10,2)) is null"
    for t, cols in SC.DECIMAL_COLUMNS.items() for c in cols))
def _audit_dec_faulty(fx: Fixture) -> DataFrame:
    return reduce(DataFrame.unionAll, [Q.audit_decimals(fx.FAULTY[t], cols, SC.PRIMARY_KEYS[t], table=t)
                                       for t, cols in SC.DECIMAL_COLUMNS.items()])


@register("check_billing_rule", f"""
select Bill_ID, Amount_Charged, Amount_Paid,
 case when Amount_Charged < 0 or Amount_Paid < 0 then 'negative_amount' end rule,
 case when Amount_Charged < 0 or Amount_Paid < 0 then '{Q.NEGATIVE_BILLING_MESSAGE}' end message
from ACCOUNT_BILLING""")
def _check_billing(fx: Fixture) -> DataFrame:
    return Q.tag_violations(fx.ACCOUNT_BILLING, Q.billing_rules()).select(
        "Bill_ID", "Amount_Charged", "Amount_Paid", "rule", "message")


@register("check_billing_rejected", f"""
select Bill_ID, Patient_ID, Amount_Charged, Amount_Paid, 'negative_amount' rule, '{Q.NEGATIVE_BILLING_MESSAGE}' message
from ACCOUNT_BILLING where Amount_Charged < 0 or Amount_Paid < 0""")
def _check_billing_rejected(fx: Fixture) -> DataFrame:
    _, rejected = Q.check_billing(fx.ACCOUNT_BILLING)
    return rejected.select("Bill_ID", "Patient_ID", "Amount_Charged", "Amount_Paid", "rule", "message")


@register("check_appointment_date_rule", f"""
select Appointment_ID, Appointment_Date,
 case when Appointment_Date < date '{AS_OF}' then 'past_date' end rule,
 case when Appointment_Date < date '{AS_OF}' then '{Q.PAST_APPOINTMENT_MESSAGE}' end message
from APPOINTMENT""")
def _check_appt(fx: Fixture) -> DataFrame:
    return Q.tag_violations(fx.APPOINTMENT, Q.appointment_date_rules(AS_OF)).select(
        "Appointment_ID", "Appointment_Date", "rule", "message")


_VALIDATE_BOOKING_SQL = f"""
with s as (select seq, Patient_ID, Doctor_ID, Appointment_Date, Appointment_Time, Department,
  trim(Patient_ID) p, trim(Doctor_ID) d, trim(Appointment_Date) dt, trim(Appointment_Time) tm, trim(Department) dep
  from BOOKING_TEXT),
v as (select *,
  case when regexp_full_match(dt, '{DATE_PATTERN}') then try_cast(regexp_extract(dt, '{DATE_PATTERN}', 1)||'-'||
   lpad(regexp_extract(dt, '{DATE_PATTERN}', 2), 2, '0')||'-'||lpad(trim(regexp_extract(dt, '{DATE_PATTERN}', 3)), 2, '0')
   as date) end pd,
  case when regexp_full_match(tm, '{TIME_PATTERN}') then cast(regexp_extract(tm, '{TIME_PATTERN}', 1) as int)*3600
   + cast(regexp_extract(tm, '{TIME_PATTERN}', 2) as int)*60 + cast(regexp_extract(tm, '{TIME_PATTERN}', 3) as int) end ps
  from s),
e as (select *, case when coalesce(length(p),0)=0 or coalesce(length(d),0)=0 or coalesce(length(dt),0)=0
   or coalesce(length(tm),0)=0 or coalesce(length(dep),0)=0 then '{Q.MSG_ALL_REQUIRED}'
  when pd is null then '{Q.MSG_BAD_DATE}' when ps is null then '{Q.MSG_BAD_TIME}' end error from v)"""


@register("validate_booking_invalid", _VALIDATE_BOOKING_SQL + """
select seq, Patient_ID, Doctor_ID, Appointment_Date, Appointment_Time, Department, error from e where error is not null""")
def _validate_booking_invalid(fx: Fixture) -> DataFrame:
    return Q.validate_requests(fx.BOOKING_TEXT, "booking")[1]


@register("validate_booking_valid", _VALIDATE_BOOKING_SQL + """
select seq, p Patient_ID, d Doctor_ID, pd Appointment_Date,
 printf('%02d:%02d:%02d', ps // 3600, (ps % 3600) // 60, ps % 60) Appointment_Time, ps sec, dep Department
from e where error is null""")
def _validate_booking_valid(fx: Fixture) -> DataFrame:
    return Q.validate_requests(fx.BOOKING_TEXT, "booking")[0]


_VALIDATE_PAYMENT_SQL = f"""
with v as (select seq, Bill_ID, amount, trim(Bill_ID) b, try_cast(trim(amount) as decimal(10,2)) a from PAYMENT_TEXT),
e as (select *, case when a is null then '{Q.MSG_BAD_AMOUNT}' when a <= 0 then '{Q.MSG_NOT_POSITIVE}' end error from v)"""


@register("validate_payments_invalid", _VALIDATE_PAYMENT_SQL + """
select seq, Bill_ID, amount, error from e where error is not null""")
def _validate_payments_invalid(fx: Fixture) -> DataFrame:
    return Q.validate_requests(fx.PAYMENT_TEXT, "payment")[1]


@register("validate_payments_valid", _VALIDATE_PAYMENT_SQL + """
select seq, b Bill_ID, a amount from e where error is null""")
def _validate_payments_valid(fx: Fixture) -> DataFrame:
    return Q.validate_requests(fx.PAYMENT_TEXT, "payment")[0]


# ---------------------------------------------------------------- batch changes

from pyspark.sql import functions as F  # noqa: E402

from medledger.operators import changes as C  # noqa: E402
from medledger.sources.tables import ensure_column  # noqa: E402


def _payments_sql(bills: str, versioned: bool, tail: str) -> str:
    v0 = "coalesce(b.version, 1)" if versioned else "1"
    return f"""
with p as (select seq, Bill_ID raw_bill, amount raw_amount, trim(Bill_ID) Bill_ID,
  try_cast(trim(amount) as decimal(10,2)) amount from PAYMENT_TEXT),
bad as (select *, case when amount is null then '{Q.MSG_BAD_AMOUNT}' when amount <= 0 then '{Q.MSG_NOT_POSITIVE}' end error from p),
j as (select v.seq, v.Bill_ID, v.amount, b.Amount_Charged charged, b.Amount_Paid paid0, {v0} v0,
  b.Bill_ID is not null found from bad v left join {bills} b on v.Bill_ID = b.Bill_ID where v.error is null),
l as (select Bill_ID, min(seq) first_ok from j where found and paid0 + amount >= 0 group by Bill_ID),
k as (select j.*, coalesce(found and not (charged < 0 or l.first_ok is null or seq < l.first_ok), false) ok
  from j left join l on j.Bill_ID = l.Bill_ID),
r as (select *, cast(paid0 + sum(amount) over w as decimal(10,2)) paid_after, count(*) over w n from k where ok
  window w as (partition by Bill_ID order by seq rows between unbounded preceding and current row)),
outcome as (
 select seq, Bill_ID, amount, true ok, paid_after Amount_Paid,
  case when paid_after >= charged then 'Paid' else 'Pending' end Payment_Status,
  {"cast(v0 + n as int)" if versioned else "cast(null as int)"} version, cast(null as string) reason,
  '{C.MSG_PAYMENT_OK}' message from r
 union all
 select seq, Bill_ID, amount, false, null, null, null,
  case when not found then 'not_found' else 'negative_amount' end,
  case when not found then '{C.MSG_PAYMENT_FAILED}' else '{Q.NEGATIVE_BILLING_MESSAGE}' end from k where not ok
 union all
 select seq, raw_bill, null, false, null, null, null, 'invalid_request', error from bad where error is not null),
t as (select Bill_ID, sum(amount) add_paid, count(*) k from k where ok group by Bill_ID),
new_bills as (
 select b.* replace (
   case when t.add_paid is null then b.Amount_Paid else cast(b.Amount_Paid + t.add_paid as decimal(10,2)) end as Amount_Paid,
   case when t.add_paid is null then b.Payment_Status
    when cast(b.Amount_Paid + t.add_paid as decimal(10,2)) >= b.Amount_Charged then 'Paid' else 'Pending' end as Payment_Status
   {", cast(coalesce(b.version, 1) + coalesce(t.k, 0) as int) as version" if versioned else ""})
 from {bills} b left join t on b.Bill_ID = t.Bill_ID)
{tail}"""


@register("payments_outcome", _payments_sql("BILLING", False, "select * from outcome"))
def _payments_outcome(fx: Fixture) -> DataFrame:
    return C.apply_payments(fx.BILLING, fx.PAYMENT_TEXT)[1]


@register("payments_bills", _payments_sql("BILLING", False, "select * from new_bills"))
def _payments_bills(fx: Fixture) -> DataFrame:
    return C.apply_payments(fx.BILLING, fx.PAYMENT_TEXT)[0]


@register("payments_versioned_outcome", _payments_sql("VISIT_BILLING", True, "select * from outcome"))
def _payments_v_outcome(fx: Fixture) -> DataFrame:
    return C.apply_payments(fx.VISIT_BILLING, fx.PAYMENT_TEXT, use_version=True)[1]


@register("payments_versioned_bills", _payments_sql("VISIT_BILLING", True, "select * from new_bills"))
def _payments_v_bills(fx: Fixture) -> DataFrame:
    return C.apply_payments(fx.VISIT_BILLING, fx.PAYMENT_TEXT, use_version=True)[0]


def _guarded_sql(tail: str) -> str:
    """Oracle: walk each bill's payments in seq order, carrying its paid amount (cents) and version."""
    return f"""
with recursive p as (select seq, Bill_ID, try_cast(amount as decimal(10,2)) amount, expected_version e from ACCOUNT_PAYMENTS),
j as (select p.seq, p.Bill_ID, p.amount, p.e, cast(p.amount * 100 as bigint) c, cast(b.Amount_Charged * 100 as bigint) ch,
  row_number() over (partition by p.Bill_ID order by p.seq) rn from p join ACCOUNT_BILLING b on b.Bill_ID = p.Bill_ID
  where p.amount > 0),
g as (
 select Bill_ID, cast(0 as bigint) rn, cast(null as bigint) seq, cast(null as varchar) reason,
  cast(Amount_Paid * 100 as bigint) paid, 1 v from ACCOUNT_BILLING
 union all
 select q.Bill_ID, q.rn, q.seq, q.reason, case when reason is null then q.paid + q.c else q.paid end,
  case when reason is null then q.v + 1 else q.v end
 from (select j.Bill_ID, j.rn, j.seq, j.c, g.paid, g.v, case when j.e is not null and j.e <> g.v then 'version_conflict'
   when j.ch < 0 or g.paid + j.c < 0 then 'negative_amount' when g.paid + j.c > {C.MAX_CENTS} then 'out_of_range' end reason
  from g join j on j.Bill_ID = g.Bill_ID and j.rn = g.rn + 1) q),
outcome as (
 select j.seq, j.Bill_ID, j.amount, g.reason is null ok,
  case when g.reason is null then cast(g.paid / 100.0 as decimal(10,2)) end Amount_Paid,
  case when g.reason is null then case when g.paid >= j.ch then 'Paid' else 'Pending' end end Payment_Status,
  case when g.reason is null then g.v end version, g.reason,
  case g.reason when 'version_conflict' then '{C.MSG_PAYMENT_FAILED}' when 'negative_amount' then '{Q.NEGATIVE_BILLING_MESSAGE}'
   when 'out_of_range' then '{C.MSG_OUT_OF_RANGE.replace("'", "''")}' else '{C.MSG_PAYMENT_OK}' end message
 from g join j on j.Bill_ID = g.Bill_ID and j.rn = g.rn),
last as (select Bill_ID, max(paid) paid, max(v) v, count(*) filter (where rn > 0 and reason is null) k from g group by Bill_ID)
{tail}"""


def _guarded(fx: Fixture):
    return C.apply_payments(ensure_column(fx.ACCOUNT_BILLING, "version", "int", 1), fx.ACCOUNT_PAYMENTS)


@register("payments_guarded_outcome", _guarded_sql("select * from outcome"))
def _payments_guarded_outcome(fx: Fixture) -> DataFrame:
    return _guarded(fx)[1]


@register("payments_guarded_bills", _guarded_sql("""
select b.* replace (case when k > 0 then cast(paid / 100.0 as decimal(10,2)) else b.Amount_Paid end as Amount_Paid,
  case when k = 0 then b.Payment_Status when paid >= cast(b.Amount_Charged * 100 as bigint) then 'Paid' else 'Pending' end as Payment_Status),
 v version from ACCOUNT_BILLING b join last on last.Bill_ID = b.Bill_ID"""))
def _payments_guarded_bills(fx: Fixture) -> DataFrame:
    return _guarded(fx)[0]


_STATUS_SQL = f"""
with c as (select seq, Appointment_ID, action, lower(trim(action)) act from STATUS_CHANGES),
j as (select c.*, a.Patient_ID, a.Appointment_Date d, a.Appointment_ID is not null found
  from c left join APPOINTMENT a on c.Appointment_ID = a.Appointment_ID),
ap as (select * from j where found and act in ('complete','cancel')),
pa as (select Appointment_ID, arg_max(act, seq) last_act from ap group by Appointment_ID),
pd as (select Patient_ID, d, arg_max(act, seq) last_bill from ap group by Patient_ID, d)"""


@register("status_changes_appointments", _STATUS_SQL + """
select a.Appointment_ID, a.Patient_ID, a.Doctor_ID, a.Department, a.Appointment_Date, a.Appointment_Time,
 case pa.last_act when 'complete' then 'Completed' when 'cancel' then 'Canceled' else a.Status end Status, a.seq, a.sec
from APPOINTMENT a left join pa on a.Appointment_ID = pa.Appointment_ID""")
def _status_appts(fx: Fixture) -> DataFrame:
    return C.apply_status_changes(fx.APPOINTMENT, fx.VISIT_BILLING, fx.STATUS_CHANGES)[0]


@register("status_changes_bills", _STATUS_SQL + """
select b.* replace (case pd.last_bill when 'complete' then 'Processing' when 'cancel' then 'Void'
  else b.Payment_Status end as Payment_Status)
from VISIT_BILLING b left join pd on b.Patient_ID = pd.Patient_ID and b.Service_Date = pd.d""")
def _status_bills(fx: Fixture) -> DataFrame:
    return C.apply_status_changes(fx.APPOINTMENT, fx.VISIT_BILLING, fx.STATUS_CHANGES)[1]


@register("status_changes_outcome", _STATUS_SQL + f"""
select seq, Appointment_ID, action, coalesce(found and act in ('complete','cancel'), false) ok,
 case when act not in ('complete','cancel') then 'invalid_request' when not found then 'not_found' end reason,
 case when act not in ('complete','cancel') then '{C.MSG_BAD_ACTION}' when not found then '{C.MSG_APPOINTMENT_NOT_FOUND}'
  when act = 'complete' then '{C.MSG_COMPLETED}' else '{C.MSG_CANCELED}' end message from j""")
def _status_outcome(fx: Fixture) -> DataFrame:
    return C.apply_status_changes(fx.APPOINTMENT, fx.VISIT_BILLING, fx.STATUS_CHANGES)[2]


_STATUS_BARRED_SQL = f"""
with c as (select seq, Appointment_ID, action, lower(trim(action)) act from STATUS_CHANGES),
bad as (select distinct Patient_ID, Service_Date from ACCOUNT_VISIT_BILLING where Amount_Charged < 0 or Amount_Paid < 0),
j as (select c.*, a.Patient_ID, a.Appointment_Date d, a.Appointment_ID is not null found, bad.Patient_ID is not null barred
  from c left join APPOINTMENT a on c.Appointment_ID = a.Appointment_ID
  left join bad on bad.Patient_ID = a.Patient_ID and bad.Service_Date = a.Appointment_Date),
ap as (select * from j where found and not barred and act in ('complete','cancel')),
pd as (select Patient_ID, d, arg_max(act, seq) last_bill from ap group by Patient_ID, d)"""


@register("status_changes_negative_bills", _STATUS_BARRED_SQL + """
select b.* replace (case pd.last_bill when 'complete' then 'Processing' when 'cancel' then 'Void'
  else b.Payment_Status end as Payment_Status)
from ACCOUNT_VISIT_BILLING b left join pd on b.Patient_ID = pd.Patient_ID and b.Service_Date = pd.d""")
def _status_negative_bills(fx: Fixture) -> DataFrame:
    return C.apply_status_changes(fx.APPOINTMENT, fx.ACCOUNT_VISIT_BILLING, fx.STATUS_CHANGES)[1]


@register("status_changes_negative_outcome", _STATUS_BARRED_SQL + f"""
select seq, Appointment_ID, action, found and not barred ok, case when barred then 'negative_amount' end reason,
 case when barred then '{Q.NEGATIVE_BILLING_MESSAGE}' when act = 'complete' then '{C.MSG_COMPLETED}'
  else '{C.MSG_CANCELED}' end message from j""")
def _status_negative_outcome(fx: Fixture) -> DataFrame:
    return C.apply_status_changes(fx.APPOINTMENT, fx.ACCOUNT_VISIT_BILLING, fx.STATUS_CHANGES)[2]


_LAB_SQL = f"""
with u as (select seq, Lab_Order_ID raw_id, Result raw_result, trim(Lab_Order_ID) Lab_Order_ID, trim(Result) Result
  from LAB_UPDATES),
v as (select * from u where length(Lab_Order_ID) > 0 and length(Result) > 0),
ids as (select distinct Lab_Order_ID from LABTEST),
j as (select v.*, i.Lab_Order_ID is not null found, length(v.Result) <= 20 fits
  from v left join ids i on v.Lab_Order_ID = i.Lab_Order_ID),
last as (select Lab_Order_ID, arg_max(Result, seq) new_result from j where found and fits group by Lab_Order_ID)"""


@register("lab_updates_labs", _LAB_SQL + """
select l.* replace (coalesce(last.new_result, l.Result) as Result)
from LABTEST l left join last on l.Lab_Order_ID = last.Lab_Order_ID""")
def _lab_labs(fx: Fixture) -> DataFrame:
    return C.update_lab_results(fx.LABTEST, fx.LAB_UPDATES)[0]


@register("lab_updates_outcome", _LAB_SQL + f"""
select seq, Lab_Order_ID, Result, found and fits ok,
 case when not found then 'not_found' when not fits then 'too_long' end reason,
 case when not found then '{C.MSG_LAB_NONE}' when not fits then '{C.MSG_LAB_TOO_LONG.replace("'", "''")}' else '{C.MSG_LAB_OK}' end message
from j
union all
select seq, raw_id, raw_result, false, 'invalid_request', '{Q.MSG_BOTH_REQUIRED}' from u
where not (coalesce(length(Lab_Order_ID), 0) > 0 and coalesce(length(Result), 0) > 0)""")
def _lab_outcome(fx: Fixture) -> DataFrame:
    return C.update_lab_results(fx.LABTEST, fx.LAB_UPDATES)[1]


RESET_FROM = "1998-01-01"


def _reset_cond():
    return (F.col("Payment_Status") == "Paid") & (F.col("Service_Date") >= F.lit(RESET_FROM).cast("date"))


@register("update_reset_paid_bills", f"""
select b.* replace (
  case when Payment_Status = 'Paid' and Service_Date >= date '{RESET_FROM}' then cast(0 as decimal(10,2)) else Amount_Paid end as Amount_Paid,
  case when Payment_Status = 'Paid' and Service_Date >= date '{RESET_FROM}' then 'Pending' else Payment_Status end as Payment_Status,
  case when Payment_Status = 'Paid' and Service_Date >= date '{RESET_FROM}' then null else Payment_Date end as Payment_Date),
 case when Payment_Status = 'Paid' and Service_Date >= date '{RESET_FROM}' then 2 else 1 end version
from BILLING b""")
def _update_reset(fx: Fixture) -> DataFrame:
    b = ensure_column(fx.BILLING, "version", "int", 1)
    return C.update_where(b, _reset_cond(), {"Amount_Paid": 0, "Payment_Status": "Pending", "Payment_Date": None,
                                              "version": F.col("version") + 1})


@register("update_reset_affected_rows", f"""
select cast(count(*) as bigint) affected_rows from BILLING
where Payment_Status = 'Paid' and Service_Date >= date '{RESET_FROM}'""")
def _update_affected(fx: Fixture) -> DataFrame:
    return C.affected_rows(fx.BILLING, _reset_cond())


@register("delete_test_prefix", """
select * from LABTEST where not coalesce(Lab_Order_ID like 'L0000001%', false)""")
def _delete_prefix(fx: Fixture) -> DataFrame:
    return C.delete_where(fx.LABTEST, F.col("Lab_Order_ID").startswith("L0000001"))


@register("delete_canceled_appointments", """
select * from APPOINTMENT where not coalesce(Status = 'Canceled', false)""")
def _delete_canceled(fx: Fixture) -> DataFrame:
    return C.delete_where(fx.APPOINTMENT, F.col("Status") == "Canceled")


# ---------------------------------------------------------------- booking

from medledger.operators import booking as BK  # noqa: E402

BOOKING_AS_OF = "2024-01-10"


@register("slot_conflicts", """
select Appointment_ID, Patient_ID, Doctor_ID, Appointment_Date, Appointment_Time, patient_conflicts, doctor_conflicts
from (select *,
  count(*) over (partition by Patient_ID, Appointment_Date order by sec range between 1799 preceding and 1799 following) - 1
   patient_conflicts,
  count(*) over (partition by Doctor_ID, Appointment_Date order by sec range between 1799 preceding and 1799 following) - 1
   doctor_conflicts
 from APPOINTMENT) where patient_conflicts > 0 or doctor_conflicts > 0""")
def _slot_conflicts(fx: Fixture) -> DataFrame:
    return BK.slot_conflicts(fx.APPOINTMENT)


def _sequential_booking_sql(requests_cte: str, existing_where: str | None, doctor_code: int, tail: str) -> str:
    """Oracle: walk each date's requests in seq order, carrying the accepted slots."""
    existing = (f"select Appointment_Date, list({{'p':Patient_ID,'d':Doctor_ID,'s':sec}}) acc0 from APPOINTMENT"
                f" where {existing_where} group by Appointment_Date" if existing_where else
                "select cast(null as date) Appointment_Date, "
                "cast([] as struct(p varchar, d varchar, s integer)[]) acc0 where false")
    return f"""
with recursive {requests_cte},
ex as ({existing}),
r as (select *, row_number() over (partition by pd order by seq) rn from req),
g as (
 select x.pd, cast(0 as bigint) rn, cast(null as bigint) seq, cast(null as int) status, cast(null as varchar) reason,
  coalesce(ex.acc0, cast([] as struct(p varchar, d varchar, s integer)[])) acc
 from (select distinct pd from r) x left join ex on ex.Appointment_Date = x.pd
 union all
 select pd, rn, seq, status, reason, case when status = 0 then list_append(acc, {{'p':p,'d':d,'s':ps}}) else acc end
 from (select r.pd, r.rn, r.seq, r.p, r.d, r.ps, g.acc,
   case when len(list_filter(g.acc, lambda x: x.p = r.p and abs(x.s - r.ps) < 1800)) > 0 then -1
        when len(list_filter(g.acc, lambda x: x.d = r.d and abs(x.s - r.ps) < 1800)) > 0 then {doctor_code}
        when not r.eligible then null else 0 end status,
   case when len(list_filter(g.acc, lambda x: x.p = r.p and abs(x.s - r.ps) < 1800)) > 0 then 'patient'
        when len(list_filter(g.acc, lambda x: x.d = r.d and abs(x.s - r.ps) < 1800)) > 0 then 'doctor'
        when r.past then 'past_date' when not r.p_ok then 'unknown_patient' when not r.d_ok then 'unknown_doctor'
   end reason
  from g join r on r.pd = g.pd and r.rn = g.rn + 1) q),
decided as (select seq, status, reason from g where rn > 0)
{tail}"""


_REPLAY_REQUESTS = """req as (select seq, Patient_ID p, Doctor_ID d, Appointment_Date pd, sec ps, true eligible,
  false past, true p_ok, true d_ok from APPOINTMENT)"""


def _replay(fx: Fixture):
    none_yet = fx.APPOINTMENT.where(F.lit(False))
    return BK.book_appointments(none_yet, fx.VISIT_BILLING.where(F.lit(False)), fx.PATIENT, fx.DOCTOR,
                                fx.BOOKING_REQUESTS, as_of=None, distinct_codes=True)


@register("booking_replay_outcome",
          _sequential_booking_sql(_REPLAY_REQUESTS, None, -2, "select seq, status from decided"))
def _booking_replay(fx: Fixture) -> DataFrame:
    return _replay(fx)[2].select("seq", "status")


@register("booking_replay_new_appointments", _sequential_booking_sql(_REPLAY_REQUESTS, None, -2, """,
ranked as (select seq, row_number() over (order by seq) k from decided where status = 0)
select 'A'||lpad(cast(k as string), cast(greatest(4, length(cast(k as string))) as integer), '0') Appointment_ID, a.Patient_ID,
 a.Doctor_ID, a.Department, a.Appointment_Date, a.Appointment_Time, 'Scheduled' Status, 1 version
from ranked join APPOINTMENT a on a.seq = ranked.seq"""))
def _booking_replay_appts(fx: Fixture) -> DataFrame:
    return _replay(fx)[0].select(*SC.APPOINTMENT.fieldNames(), "version")


_HISTORY_REQUESTS = _VALIDATE_BOOKING_SQL.strip()[len("with "):] + f""",
pats as (select distinct Patient_ID from PATIENT), docs as (select distinct Doctor_ID from DOCTOR),
req as (select seq, p, d, pd, ps, pd < date '{BOOKING_AS_OF}' past, p in (select Patient_ID from pats) p_ok,
  d in (select Doctor_ID from docs) d_ok,
  not (pd < date '{BOOKING_AS_OF}') and p in (select Patient_ID from pats) and d in (select Doctor_ID from docs) eligible
 from e where error is null)"""


def _history(fx: Fixture):
    history = fx.APPOINTMENT.where(F.col("Status") == "Completed")
    return BK.book_appointments(history, fx.VISIT_BILLING, fx.PATIENT, fx.DOCTOR, fx.BOOKING_TEXT,
                                as_of=BOOKING_AS_OF)


@register("booking_history_outcome", _sequential_booking_sql(
    _HISTORY_REQUESTS, "Status = 'Completed'", -1, """
select seq, status, reason from decided
union all select seq, null, 'invalid_request' from e where error is not null"""))
def _booking_history(fx: Fixture) -> DataFrame:
    return _history(fx)[2].select("seq", "status", "reason")


# A second, disjoint set of calls into a book that holds every appointment, Canceled ones too.
_SHIFTED_REQUESTS = """req as (select seq, Patient_ID p, Doctor_ID d, Appointment_Date pd, (sec + 2700) % 86400 ps, true eligible,
  false past, true p_ok, true d_ok from APPOINTMENT)"""


def _full_book(fx: Fixture):
    return BK.book_new_rows(fx.APPOINTMENT, fx.VISIT_BILLING, fx.PATIENT, fx.DOCTOR, fx.SHIFTED_REQUESTS)


_FULL_IDS = """,
top as (select max(cast(substring(Appointment_ID, 2) as bigint)) t from APPOINTMENT),
ids as (select seq, 'A'||lpad(cast(t + k as string), cast(greatest(4, length(cast(t + k as string))) as integer), '0') Appointment_ID
 from (select seq, row_number() over (order by seq) k from decided where status = 0), top)
select d.seq, d.status, d.reason, ids.Appointment_ID from decided d left join ids on ids.seq = d.seq"""


ORACLE_OF_FULL_BOOK = _sequential_booking_sql(_SHIFTED_REQUESTS, "true", -1, _FULL_IDS)


@register("booking_full_book_outcome", ORACLE_OF_FULL_BOOK)
def _booking_full_book(fx: Fixture) -> DataFrame:
    return _full_book(fx)[2].select("seq", "status", "reason", "Appointment_ID")


@register("request_conflicts_full_book", """
with r as (select seq, Patient_ID, Doctor_ID, Appointment_Date, (sec + 2700) % 86400 s from APPOINTMENT),
p as (select r.seq, count(*) n from r join APPOINTMENT a on a.Patient_ID = r.Patient_ID
  and a.Appointment_Date = r.Appointment_Date and abs(a.sec - r.s) < 1800 group by r.seq),
d as (select r.seq, count(*) n from r join APPOINTMENT a on a.Doctor_ID = r.Doctor_ID
  and a.Appointment_Date = r.Appointment_Date and abs(a.sec - r.s) < 1800 group by r.seq)
select r.seq, cast(coalesce(p.n, 0) as bigint) patient_conflicts, cast(coalesce(d.n, 0) as bigint) doctor_conflicts,
 case when p.n > 0 then 'patient' when d.n > 0 then 'doctor' end reason
from r left join p on p.seq = r.seq left join d on d.seq = r.seq""")
def _request_conflicts(fx: Fixture) -> DataFrame:
    return BK.request_conflicts(fx.APPOINTMENT, fx.SHIFTED_REQUESTS)


# ---------------------------------------------------------------- SQL function and streams

import uuid  # noqa: E402

from medledger.plans.sql_functions import register_sql_functions  # noqa: E402
from medledger.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402
from medledger.streaming import streams as ST  # noqa: E402


@register("outstanding_bill_sql_function", _ORACLE_TEXT["outstanding_bill_per_patient"])
def _outstanding_sql_fn(fx: Fixture) -> DataFrame:
    tag = "medledger"  # the same two views for every call
    fx.BILLING.createOrReplaceTempView(f"billing_{tag}")
    fx.PATIENT.createOrReplaceTempView(f"patient_{tag}")
    register_sql_functions(fx.spark, f"billing_{tag}")
    return fx.spark.sql(f"SELECT Patient_ID, CalculateOutstandingBill(Patient_ID) AS Outstanding_Bill FROM patient_{tag}")


def _scratch(fx: Fixture, name: str) -> str:
    return f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/medledger/{name}-{uuid.uuid4().hex}"


@register("stream_check_billing_rejected", _ORACLE_TEXT["check_billing_rejected"])
def _stream_billing(fx: Fixture) -> DataFrame:
    root = _scratch(fx, "billing-stream")
    fx.ACCOUNT_BILLING.write.parquet(f"{root}/source")
    q = ST.check_billing_stream(fx.spark, f"{root}/source", f"{root}/accepted", f"{root}/rejected",
                                checkpoint=f"{root}/checkpoint")
    q.awaitTermination()
    return fx.spark.read.parquet(f"{root}/rejected").select(
        "Bill_ID", "Patient_ID", "Amount_Charged", "Amount_Paid", "rule", "message")


@register("stream_check_appointment_rejected", f"""
select Appointment_ID, Appointment_Date, 'past_date' rule, '{Q.PAST_APPOINTMENT_MESSAGE}' message
from APPOINTMENT where Appointment_Date < date '{AS_OF}'""")
def _stream_appointments(fx: Fixture) -> DataFrame:
    root = _scratch(fx, "appointment-stream")
    fx.APPOINTMENT.select(*SC.APPOINTMENT.fieldNames()).write.parquet(f"{root}/source")
    q = ST.check_appointment_stream(fx.spark, f"{root}/source", f"{root}/accepted", f"{root}/rejected", AS_OF,
                                    checkpoint=f"{root}/checkpoint")
    q.awaitTermination()
    return fx.spark.read.parquet(f"{root}/rejected").select("Appointment_ID", "Appointment_Date", "rule", "message")


@register("stream_check_billing_accepted", """
select * from ACCOUNT_BILLING where not coalesce(Amount_Charged < 0 or Amount_Paid < 0, false)""")
def _stream_billing_accepted(fx: Fixture) -> DataFrame:
    root = _scratch(fx, "billing-stream")
    fx.ACCOUNT_BILLING.write.parquet(f"{root}/source")
    q = ST.check_billing_stream(fx.spark, f"{root}/source", f"{root}/accepted", f"{root}/rejected",
                                checkpoint=f"{root}/checkpoint")
    q.awaitTermination()
    return fx.spark.read.parquet(f"{root}/accepted").drop("batch_id")


#: Calls in one file of a feed: a file is one task's work for a stream, so a step has as many files as it has such portions.
ROWS_PER_FILE = 250_000


def _feed(fx: Fixture, calls: DataFrame, path: str, parts: int = 3, files: int = 4) -> int:
    """Write calls in ``parts`` steps of ascending ``seq``, each as ``files`` files or more; returns the files per step."""
    held = cut_lineage(calls)
    low, high, rows = held.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    files = max(files, rows // (parts * ROWS_PER_FILE) + 1)
    for k in range(parts):
        lo, hi = (low + (high + 1 - low) * x // parts for x in (k, k + 1))
        held.where(F.col("seq").between(lo, hi - 1)).repartitionByRange(files, "seq").write.mode("append").parquet(path)
    return files


@register("booking_stream_outcome", ORACLE_OF_FULL_BOOK)
def _booking_stream(fx: Fixture) -> DataFrame:
    root = _scratch(fx, "booking-stream")
    step = _feed(fx, fx.SHIFTED_REQUESTS, f"{root}/source", parts=2)
    book = fx.APPOINTMENT.select(*SC.APPOINTMENT.fieldNames())
    q = ST.booking_stream(fx.spark, f"{root}/source", book, fx.VISIT_BILLING, fx.PATIENT, fx.DOCTOR, f"{root}/out",
                          checkpoint=f"{root}/checkpoint", max_files_per_trigger=step)
    q.awaitTermination()
    return fx.spark.read.parquet(f"{root}/out/outcome").select("seq", "status", "reason", "Appointment_ID")


@register("payment_stream_bills", _ORACLE_TEXT["payments_bills"])
def _payment_stream(fx: Fixture) -> DataFrame:
    root = _scratch(fx, "payment-stream")
    step = _feed(fx, fx.PAYMENT_TEXT, f"{root}/source")
    q = ST.payment_stream(fx.spark, f"{root}/source", fx.BILLING, f"{root}/out", checkpoint=f"{root}/checkpoint",
                          max_files_per_trigger=step)
    q.awaitTermination()
    return ST.current_bills(fx.spark, fx.BILLING, f"{root}/out")


# ---------------------------------------------------------------- stored tables and inserts

from medledger.sources.tables import DUPLICATE_KEY_MESSAGE, append_rows, insert_each, load_tables, tables_present, write_snapshot  # noqa: E402


def _declared(fx: Fixture, name: str) -> DataFrame:
    """A table with all its declared columns; those without data hold a text of at most their declared length."""
    df = getattr(fx, name)
    limits = SC.LENGTH_LIMITS[name]
    return df.select(*[(F.col(f.name) if f.name in df.columns else
                        (F.lit("1980-02-03") if f.name == "DOB" else F.lit(f"{f.name} text"[:limits.get(f.name)]))).cast(f.dataType).alias(f.name)
                       for f in SC.TABLES[name].fields])


def _stored(fx: Fixture) -> dict[str, DataFrame]:
    """The six tables written with all declared columns, then loaded and checked against their schemas."""
    root = _scratch(fx, "tables")
    for name in SC.TABLES:
        write_snapshot(_declared(fx, name), f"{root}/{name}")
    return load_tables(fx.spark, root)


@register("stored_tables_outstanding", """
select Patient_ID, cast(sum(Amount_Charged - Amount_Paid) as decimal(21,2)) Total_Outstanding
from BILLING where Payment_Status = 'Pending' group by Patient_ID""")
def _stored_outstanding(fx: Fixture) -> DataFrame:
    return R.outstanding_by_patient(_stored(fx)["BILLING"])


def _new_bills(fx: Fixture) -> DataFrame:
    """Account bills under new ids (negative ones are among them), then stored bills once more."""
    new = fx.ACCOUNT_BILLING.withColumn("Bill_ID", F.concat(F.lit("N"), F.substr("Bill_ID", F.lit(2))))
    both = new.withColumn("call", F.concat(F.lit("1"), "Bill_ID")).unionByName(
        fx.BILLING.select(*new.columns).withColumn("call", F.concat(F.lit("2"), "Bill_ID")))
    return both


@register("append_bills_with_defaults", """
select *, 1 version from BILLING
union all select * replace ('N'||substring(Bill_ID, 2) as Bill_ID), 1 from ACCOUNT_BILLING where Amount_Charged >= 0""")
def _append_bills(fx: Fixture) -> DataFrame:
    bills = ensure_column(_stored(fx)["BILLING"], "version", "int", 1)
    return insert_each(bills, _new_bills(fx), "BILLING", "call", Q.billing_rules())[0]


@register("insert_bills_refused", f"""
select '1N'||substring(Bill_ID, 2) as "call", 'N'||substring(Bill_ID, 2) Bill_ID, 'negative_amount' rule,
 '{Q.NEGATIVE_BILLING_MESSAGE}' message from ACCOUNT_BILLING where Amount_Charged < 0
union all select '2'||Bill_ID, Bill_ID, 'duplicate_key', '{DUPLICATE_KEY_MESSAGE.replace("'", "''")}' from BILLING""")
def _insert_refused(fx: Fixture) -> DataFrame:
    bills = ensure_column(_stored(fx)["BILLING"], "version", "int", 1)
    outcome = insert_each(bills, _new_bills(fx), "BILLING", "call", Q.billing_rules())[1]
    return outcome.where("NOT ok").drop("ok")


@register("append_appointments_checked", f"""
select Appointment_ID, Patient_ID, Doctor_ID, Department, Appointment_Date, Appointment_Time, Status from APPOINTMENT
union all
select 'N'||substring(Appointment_ID, 2), Patient_ID, Doctor_ID, Department, Appointment_Date, Appointment_Time, Status
from APPOINTMENT where Appointment_Date >= date '{AS_OF}'""")
def _append_appointments(fx: Fixture) -> DataFrame:
    tables = _stored(fx)
    stored = tables["APPOINTMENT"]
    new = stored.withColumn("Appointment_ID", F.concat(F.lit("N"), F.substr("Appointment_ID", F.lit(2))))
    return insert_each(stored, new, "APPOINTMENT", "Appointment_ID", Q.appointment_date_rules(AS_OF), tables)[0]


@register("append_lab_tests_by_position", """
select * from LABTEST union all
select 'N'||substring(Lab_Order_ID, 2), Patient_ID, Test_Type, Order_Date, Scheduled_Date, 'Pending' from LABTEST""")
def _append_labs(fx: Fixture) -> DataFrame:
    """INSERT INTO .. SELECT: every test is ordered once more; columns in the table's order under other names."""
    labs = fx.LABTEST
    again = labs.select(*[{"Lab_Order_ID": F.concat(F.lit("N"), F.substr("Lab_Order_ID", F.lit(2))),
                           "Result": F.lit("Pending")}.get(c, F.col(c)).alias(f"c{k}") for k, c in enumerate(labs.columns)])
    return append_rows(labs, again, "LABTEST", positional=True)


#: The rows that the demo inserts one by one, a refused one first.
DEMO_BILLS = [("B9999", "P0001", "Test Service", dt.date(2025, 6, 20), Decimal("-100.00"), Decimal("0.00"), None, "Pending"),
              ("B9999", "P0001", "Test Service", dt.date(2025, 6, 20), Decimal("100.00"), Decimal("0.00"), None, "Pending")]


@register("insert_single_bills", """
select Bill_ID, Patient_ID, Service_Type, Service_Date, Amount_Charged, Amount_Paid, Payment_Date, Payment_Status from BILLING
union all select 'B9999', 'P0001', 'Test Service', date '2025-06-20', 100.00, 0.00, null, 'Pending'
where not exists (select 1 from BILLING where Bill_ID = 'B9999')""")
def _insert_single(fx: Fixture) -> DataFrame:
    bills = _stored(fx)["BILLING"]
    for row in DEMO_BILLS:
        one = fx.spark.createDataFrame([row], SC.BILLING).withColumn("call", F.lit(1))
        bills, _ = insert_each(bills, one, "BILLING", "call", Q.billing_rules())
    return bills


@register("tables_present_in_catalog", """
with expected(name) as (values ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('billing_archive'))
select name, name in (select table_name from information_schema.tables) present from expected""")
def _tables_present(fx: Fixture) -> DataFrame:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    for name in names:
        fx.spark.read.parquet(f"{fx.sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return tables_present(fx.spark, [*names, "billing_archive"])


@register("next_bill_ids_for_visits", """
with top as (select coalesce(max(try_cast(substring(Bill_ID, 2) as bigint)), 0) t from BILLING),
r as (select seq, Patient_ID, row_number() over (order by seq) k from APPOINTMENT)
select seq, Patient_ID, 'B'||lpad(cast(t + k as string), cast(greatest(4, length(cast(t + k as string))) as integer), '0')
 Bill_ID from r, top""")
def _next_bill_ids(fx: Fixture) -> DataFrame:
    visits = fx.APPOINTMENT.select("seq", "Patient_ID")
    return BK.next_ids(fx.BILLING, "Bill_ID", visits, "seq", "B", "Bill_ID")


@register("booking_replay_new_bills", _sequential_booking_sql(_REPLAY_REQUESTS, None, -2, """,
ranked as (select seq, row_number() over (order by seq) k from decided where status = 0)
select 'B'||lpad(cast(k as string), cast(greatest(4, length(cast(k as string))) as integer), '0') Bill_ID,
 a.Patient_ID, a.Department||' Consultation' Service_Type, a.Appointment_Date Service_Date,
 cast(200 as decimal(10,2)) Amount_Charged, cast(0 as decimal(10,2)) Amount_Paid, cast(null as date) Payment_Date,
 'Pending' Payment_Status, 1 version
from ranked join APPOINTMENT a on a.seq = ranked.seq"""))
def _booking_replay_bills(fx: Fixture) -> DataFrame:
    return _replay(fx)[1]


# ---------------------------------------------------------------- tables by month, of the catalog, and file footers

import uuid  # noqa: E402

from medledger.plans.sql_functions import register_report_function  # noqa: E402
from medledger.sources import stored as SD  # noqa: E402


def _by_month(fx: Fixture, table: str, date_column: str) -> DataFrame:
    path = f"{_scratch(fx, 'by-month')}/{table}"
    SD.write_by_month(_declared(fx, table), path, date_column, SC.PRIMARY_KEYS[table])
    return fx.spark.read.parquet(path)


@register("pending_lab_tests_by_month", _ORACLE_TEXT["pending_lab_tests_before"])
def _pending_labs_by_month(fx: Fixture) -> DataFrame:
    return R.pending_lab_tests_before(_by_month(fx, "LABTEST", "Scheduled_Date"), LAB_CUTOFF)


@register("prescriptions_by_month", _ORACLE_TEXT["prescriptions_between"])
def _prescriptions_by_month(fx: Fixture) -> DataFrame:
    return R.prescriptions_between(_by_month(fx, "PRESCRIPTION", "Date_Issued"), fx.DOCTOR, RX_FROM, RX_TO)


@register("footer_row_counts", _ORACLE_TEXT["row_counts"])
def _footer_row_counts(fx: Fixture) -> DataFrame:
    root = _scratch(fx, "tables")
    for name in SC.TABLES:
        write_snapshot(_declared(fx, name), f"{root}/{name}")
    return SD.footer_counts(fx.spark, {name: f"{root}/{name}" for name in SC.TABLES})


@register("footer_bill_dates", """
select count(*) "rows", min(Service_Date) lowest, max(Service_Date) highest from BILLING""")
def _footer_bill_dates(fx: Fixture) -> DataFrame:
    path = f"{_scratch(fx, 'tables')}/BILLING"
    write_snapshot(_declared(fx, "BILLING"), path)
    return SD.footer_extent(fx.spark, path, "Service_Date")


def _database(fx: Fixture, names: list[str], buckets: int | None = None) -> str:
    database = f"medledger_{uuid.uuid4().hex[:12]}"
    SD.create_tables(fx.spark, database, _scratch(fx, "database"), names, buckets)
    for name in names:
        SD.insert_rows(fx.spark, database, name, _declared(fx, name))
    return database


@register("catalog_outstanding_bills", _ORACLE_TEXT["outstanding_bills"])
def _catalog_outstanding(fx: Fixture) -> DataFrame:
    """Both tables are bucketed by patient: no shuffle for the sums and the join."""
    database = _database(fx, ["PATIENT", "BILLING"], 8)
    return R.outstanding_bills(fx.spark.table(f"{database}.PATIENT"), fx.spark.table(f"{database}.BILLING"))


@register("catalog_bills_with_version", """
select *, 1 version from BILLING
union all select * replace ('N'||substring(Bill_ID, 2) as Bill_ID), 1 from ACCOUNT_BILLING where Amount_Charged >= 0""")
def _catalog_versions(fx: Fixture) -> DataFrame:
    """The column comes after the bills; account bills come after the column, without a value for it."""
    database = _database(fx, ["BILLING"])
    SD.add_column(fx.spark, database, "BILLING")
    new = fx.ACCOUNT_BILLING.withColumn("Bill_ID", F.concat(F.lit("N"), F.substr("Bill_ID", F.lit(2))))
    SD.insert_rows(fx.spark, database, "BILLING", new.where("Amount_Charged >= 0"))
    return fx.spark.table(f"{database}.BILLING")


@register("patient_report_sql_function", _ORACLE_TEXT["patient_report"])
def _report_sql_function(fx: Fixture) -> DataFrame:
    tag = uuid.uuid4().hex[:12]
    R.patient_report(fx.APPOINTMENT, fx.LABTEST, fx.BILLING).createOrReplaceTempView(f"report_{tag}")
    fx.PATIENT.createOrReplaceTempView(f"patient_{tag}")
    register_report_function(fx.spark, f"report_{tag}")
    return fx.spark.sql(f"SELECT p.Patient_ID, r.* FROM patient_{tag} p, LATERAL PatientReport(p.Patient_ID) r")


@register("lookup_collated_status", """
select * from BILLING where lower(rtrim(Payment_Status, ' ')) = 'pending'""")
def _lookup_collated(fx: Fixture) -> DataFrame:
    return R.lookup(fx.BILLING, "Payment_Status", "pENDING  ", collation="UTF8_LCASE_RTRIM")
