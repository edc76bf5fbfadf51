"""The fixture mapping as portable SQL text, for the DuckDB oracles.

Each entry is the body of a CTE over the driver's tables; ``with_views``
prefixes a query with the CTEs it needs (in dependency order).
"""

from __future__ import annotations

import re

from medledger.sources.schemas import LENGTH_LIMITS, PRIMARY_KEYS, TABLES

VIEWS: dict[str, str] = {
    "PATIENT": """
select concat('P',lpad(cast(c_custkey as string),8,'0')) Patient_ID, c_name Full_Name from customer""",
    "DOCTOR": """
select concat('D',lpad(cast(s_suppkey as string),8,'0')) Doctor_ID, s_name Full_Name, r_name Department
from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "APPOINTMENT": """
select concat('A',lpad(cast(event_id as string),8,'0')) Appointment_ID,
 concat('P',lpad(cast(user_id as string),8,'0')) Patient_ID, d.Doctor_ID, d.Department,
 cast(ts as date) Appointment_Date, substring(cast(ts as string),12,8) Appointment_Time,
 case event_type when 'purchase' then 'Completed' when 'error' then 'Canceled' else 'Scheduled' end Status,
 event_id seq, cast(hour(ts)*3600+minute(ts)*60+second(ts) as int) sec
from events cross join (select count(*) n from supplier) k
join DOCTOR d on d.Doctor_ID=concat('D',lpad(cast((event_id*7919+user_id*104729) % n as string),8,'0'))""",
    "LABTEST": """
select concat('L',lpad(cast(o_orderkey as string),8,'0')) Lab_Order_ID,
 concat('P',lpad(cast(o_custkey as string),8,'0')) Patient_ID, o_orderpriority Test_Type,
 cast(o_orderdate as date) Order_Date, cast(o_orderdate as date)+2 Scheduled_Date,
 case o_orderstatus when 'P' then 'Pending' when 'F' then 'Normal' else 'Abnormal' end Result from orders""",
    "PRESCRIPTION": """
select concat('PR',lpad(cast(l_orderkey as string),8,'0'),'-',cast(l_linenumber as string)) Prescription_ID,
 concat('P',lpad(cast(o_custkey as string),8,'0')) Patient_ID,
 concat('D',lpad(cast(l_suppkey as string),8,'0')) Doctor_ID, cast(l_shipdate as date) Date_Issued,
 p_name Medication_Name, concat(cast(cast(l_quantity as int) as string),'mg') Dosage
from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey""",
    "BILLING": """
select concat('B',lpad(cast(o_orderkey as string),8,'0')) Bill_ID,
 concat('P',lpad(cast(o_custkey as string),8,'0')) Patient_ID,
 concat(o_orderpriority,' Consultation') Service_Type, cast(o_orderdate as date) Service_Date,
 cast(o_totalprice as decimal(10,2)) Amount_Charged,
 case o_orderstatus when 'F' then cast(o_totalprice as decimal(10,2))
  when 'O' then cast(cast(o_totalprice as decimal(10,2))*cast(0.5 as decimal(2,1)) as decimal(10,2))
  else cast(0 as decimal(10,2)) end Amount_Paid,
 case o_orderstatus when 'F' then cast(o_orderdate as date) end Payment_Date,
 case o_orderstatus when 'F' then 'Paid' else 'Pending' end Payment_Status from orders""",
    "VISIT_BILLING": """
select concat('B',lpad(cast(seq as string),8,'0')) Bill_ID, Patient_ID, concat(Department,' Consultation') Service_Type,
 Appointment_Date Service_Date, cast(200 as decimal(10,2)) Amount_Charged, cast(0 as decimal(10,2)) Amount_Paid,
 cast(null as date) Payment_Date, 'Pending' Payment_Status, 1 version from APPOINTMENT""",
    "ACCOUNT_BILLING": """
select concat('C',lpad(cast(c_custkey as string),8,'0')) Bill_ID,
 concat('P',lpad(cast(c_custkey as string),8,'0')) Patient_ID, c_mktsegment Service_Type,
 cast('2025-01-01' as date) Service_Date, cast(c_acctbal as decimal(10,2)) Amount_Charged,
 cast(0 as decimal(10,2)) Amount_Paid, cast(null as date) Payment_Date, 'Pending' Payment_Status from customer""",
    "PAYMENTS": """
select cast(row_number() over (order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate) as bigint) seq,
 concat('B',lpad(cast(l_orderkey as string),8,'0')) Bill_ID,
 cast(cast(l_extendedprice as decimal(10,2)) as string) amount from lineitem""",
    "STATUS_CHANGES": """
select seq, Appointment_ID, case Status when 'Completed' then 'complete' else 'cancel' end action
from APPOINTMENT where Status<>'Scheduled'""",
    "LAB_UPDATES": """
select cast(row_number() over (order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate,l_returnflag) as bigint) seq,
 concat('L',lpad(cast(l_orderkey as string),8,'0')) Lab_Order_ID,
 case l_returnflag when 'R' then 'Abnormal' when 'A' then 'Normal' else 'Pending' end Result from lineitem""",
    "BOOKING_TEXT": """
select seq, Patient_ID, Doctor_ID,
 case Status when 'Canceled' then strftime(Appointment_Date,'%y-%m-%d')
  when 'Completed' then strftime(Appointment_Date,'%Y-%-m-%-d') else cast(Appointment_Date as string) end Appointment_Date,
 case when Status='Completed' then cast(sec // 3600 as string)||':'||cast((sec % 3600) // 60 as string)||':'||cast(sec % 60 as string)
  when Department='EUROPE' then substring(Appointment_Time,1,5) else Appointment_Time end Appointment_Time,
 case when Status='Scheduled' and sec < 3600 then '  ' else Department end Department
from APPOINTMENT""",
    "PAYMENT_TEXT": """
select seq, Bill_ID, case when cast(amount as decimal(10,2)) < 1000 then '-'||amount
  when cast(amount as decimal(10,2)) < 1100 then 'n/a' else amount end amount from PAYMENTS""",
}

VIEWS["ACCOUNT_VISIT_BILLING"] = """
select v.* replace (cast(c_acctbal as decimal(10,2)) as Amount_Charged) from VISIT_BILLING v
join customer on v.Patient_ID = concat('P',lpad(cast(c_custkey as string),8,'0'))"""
VIEWS["ACCOUNT_PAYMENTS"] = """
select o_orderkey seq, concat('C',lpad(cast(o_custkey as string),8,'0')) Bill_ID,
 cast(cast(cast(o_totalprice as decimal(12,2)) * 40 as decimal(12,2)) as string) amount,
 case when o_orderkey % 3 <> 0 then cast(o_orderkey % 5 + 1 as int) end expected_version from orders"""

# Columns that the mapping itself provides.
_MAPPED = {
    "PATIENT": ("Patient_ID", "Full_Name"), "DOCTOR": ("Doctor_ID", "Full_Name", "Department"),
    "PRESCRIPTION": ("Prescription_ID", "Patient_ID", "Doctor_ID", "Date_Issued", "Medication_Name", "Dosage"),
}


def _faulty(table: str) -> str:
    """The table with every declared column and faults placed by the number n in the key: in column i, NULL
    where n % 97 = i, an unknown parent where n % 83 = i, a text one too long where n % 79 = i, an amount out of
    range where n % 89 = i."""
    key, cols = PRIMARY_KEYS[table], []
    for i, f in enumerate(TABLES[table].fields):
        has = f.name in _MAPPED.get(table, TABLES[table].fieldNames())
        c = f.name if has else ("date '1980-02-03'" if f.name == "DOB" else f"'{f.name} text'")
        if f.name == key:
            cols.append(f"{key}")
            continue
        if f.name in ("Amount_Charged", "Amount_Paid"):
            c = f"case when n % 89 = {i} then cast(1000000000 as decimal(14,2)) else cast({c} as decimal(14,2)) end"
        elif f.name in ("Patient_ID", "Doctor_ID"):
            c = f"case when n % 83 = {i} then 'X404' else {c} end"
        elif f.name in LENGTH_LIMITS[table]:
            c = f"case when n % 79 = {i} then repeat('z', {LENGTH_LIMITS[table][f.name] + 1}) else {c} end"
        cols.append(f"case when n % 97 <> {i} then {c} end {f.name}")
    number = f"cast(regexp_replace({key}, '[^0-9]', '', 'g') as bigint)"
    return f"select {', '.join(cols)} from (select *, {number} n from {table})"


VIEWS |= {f"FAULTY_{t}": _faulty(t) for t in TABLES}

_ORDER = list(VIEWS)


def _deps(name: str) -> set[str]:
    body = VIEWS[name]
    return {v for v in VIEWS if v != name and re.search(rf"\b{v}\b", body)}


def with_views(query: str) -> str:
    """Prefix ``query`` with the fixture CTEs it references (and theirs)."""
    needed: set[str] = set()
    todo = [v for v in VIEWS if re.search(rf"\b{v}\b", query)]
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo.extend(_deps(v))
    ordered = [v for v in _ORDER if v in needed]
    if not ordered:
        return query
    ctes = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in ordered)
    q = query.strip()
    if q.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{q[15:]}"
    if q.lower().startswith("with "):
        return f"with {ctes},\n{q[5:]}"
    return f"with {ctes}\n{q}"
