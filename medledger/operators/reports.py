"""Report queries and lookups (user-facing results).

Design notes for scale:
* Aggregations over fact tables run before joins to the dimension, so a hot
  patient or doctor is combined map-side (partial aggregation) instead of
  being shuffled whole into one task.
* Dimension sides are grouped to (key, name) with a multiplicity, which keeps
  the results identical to the join-then-group SQL even if a key repeats.
* Orders are global sorts (range partitioning), never single-partition windows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medledger.operators.ordering import global_rank

MONEY_SUM = "decimal(21,2)"


def _date(value: str | dt.date | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def month_column(date_column: str) -> str:
    """The column that tables stored by month of ``date_column`` have besides."""
    return f"{date_column}_Month"


def month_of(date: Column) -> Column:
    """yyyymm as a number; null for a null date."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def _in_months(df: DataFrame, date_column: str, lo=None, hi=None) -> DataFrame:
    """Only the months that dates from ``lo`` to ``hi`` fall in, where ``df`` is stored by month (else ``df``)."""
    month = month_column(date_column)
    if month not in df.columns:
        return df
    if lo is not None:
        df = df.where(F.col(month) >= month_of(_date(lo)))
    return df if hi is None else df.where(F.col(month) <= month_of(_date(hi)))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(Table_Name, Record_Count) for each table, as one UNION ALL."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("Record_Count")).select(
            F.lit(name).alias("Table_Name"), "Record_Count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def lookup(df: DataFrame, column: str, value, collation: str | None = None) -> DataFrame:
    """``SELECT * WHERE column = value`` (pushed down to the scan).

    ``collation`` (such as ``UTF8_LCASE_RTRIM``: neither case nor trailing blanks count) compares as a database of that collation
    does; such a comparison is not pushed down.
    """
    if collation is not None:
        return df.where(F.collate(F.col(column), collation) == F.collate(F.lit(value), collation))
    return df.where(F.col(column) == F.lit(value))


def _doctor_names(doctors: DataFrame) -> DataFrame:
    return doctors.select("Doctor_ID", F.col("Full_Name").alias("Doctor_Name"))


def patient_appointment_history(appts: DataFrame, doctors: DataFrame, patient_id: str) -> DataFrame:
    """One patient's appointments with the doctor's name, by date and time."""
    a = appts.where(F.col("Patient_ID") == F.lit(patient_id))
    return (
        a.join(_doctor_names(doctors), "Doctor_ID")
        .select("Appointment_ID", "Appointment_Date", "Appointment_Time", "Department", "Status", "Doctor_Name")
        .orderBy("Appointment_Date", "Appointment_Time", "Appointment_ID")
    )


def _pending_totals(bills: DataFrame) -> DataFrame:
    return (
        bills.where(F.col("Payment_Status") == "Pending")
        .groupBy("Patient_ID")
        .agg(F.sum(F.col("Amount_Charged") - F.col("Amount_Paid")).alias("_total"))
    )


def outstanding_bills(patients: DataFrame, bills: DataFrame) -> DataFrame:
    """Patients whose Pending bills leave a positive balance, with their names."""
    joined = patients.select("Patient_ID", "Full_Name").join(_pending_totals(bills), "Patient_ID")
    return (
        joined.select("Patient_ID", "Full_Name", F.col("_total").cast(MONEY_SUM).alias("Total_Outstanding"))
        .where(F.col("Total_Outstanding") > 0)
    )


def outstanding_by_patient(bills: DataFrame) -> DataFrame:
    """Sum of charged minus paid over Pending bills per patient; zero and negative totals stay."""
    return _pending_totals(bills).select("Patient_ID", F.col("_total").cast(MONEY_SUM).alias("Total_Outstanding"))


def pending_lab_tests_before(labs: DataFrame, cutoff) -> DataFrame:
    """Pending tests scheduled strictly before ``cutoff``."""
    labs = _in_months(labs, "Scheduled_Date", hi=cutoff)
    return labs.where((F.col("Result") == "Pending") & (F.col("Scheduled_Date") < _date(cutoff))).select(
        "Lab_Order_ID", "Patient_ID", "Test_Type", "Scheduled_Date")


def prescriptions_between(rx: DataFrame, doctors: DataFrame, lo, hi) -> DataFrame:
    """Prescriptions issued in the inclusive range [lo, hi] with the doctor's name, by date."""
    r = _in_months(rx, "Date_Issued", lo, hi).where(F.col("Date_Issued").between(_date(lo), _date(hi)))
    return (
        r.join(_doctor_names(doctors), "Doctor_ID")
        .select("Prescription_ID", "Patient_ID", "Doctor_Name", "Medication_Name", "Dosage", "Date_Issued")
        .orderBy("Date_Issued", "Prescription_ID")
    )


def _appointment_counts(appts: DataFrame) -> DataFrame:
    return appts.groupBy("Doctor_ID").agg(
        F.count("Appointment_ID").alias("_total"),
        F.sum(F.when(F.col("Status") == "Completed", 1).otherwise(0)).alias("_completed"),
    )


def doctor_appointment_stats(doctors: DataFrame, appts: DataFrame) -> DataFrame:
    """Every doctor (also those with no appointment): total and completed, busiest first."""
    j = doctors.select("Doctor_ID", "Full_Name").join(_appointment_counts(appts), "Doctor_ID", "left")
    return (
        j.select(
            "Doctor_ID", "Full_Name",
            F.coalesce(F.col("_total"), F.lit(0)).cast("bigint").alias("Total_Appointments"),
            F.coalesce(F.col("_completed"), F.lit(0)).cast("bigint").alias("Completed_Appointments"),
        )
        .orderBy(F.desc("Total_Appointments"), "Doctor_ID")
    )


def doctor_appointment_counts(doctors: DataFrame, appts: DataFrame) -> DataFrame:
    """Every doctor with its appointment count (zero when none)."""
    j = doctors.select("Doctor_ID").join(_appointment_counts(appts), "Doctor_ID", "left")
    return j.select(
        "Doctor_ID",
        F.coalesce(F.col("_total"), F.lit(0)).cast("bigint").alias("Total_Appointments"),
    )


def outstanding_bill(patient_ids: DataFrame, bills: DataFrame) -> DataFrame:
    """Scalar function per requested id: Pending balance as DECIMAL(10,2), 0.00 when none."""
    j = patient_ids.select("Patient_ID").join(_pending_totals(bills), "Patient_ID", "left")
    value = F.coalesce(F.col("_total"), F.lit(0)).cast("decimal(10,2)")
    return j.select("Patient_ID", value.alias("Outstanding_Bill"))


def patient_report(appts: DataFrame, labs: DataFrame, bills: DataFrame, ids: DataFrame | None = None,
                   with_positions: bool = False) -> DataFrame:
    """Appointments, lab tests and bills per patient, each section newest first.

    Long form: one row per record with a ``section`` tag and a balance for
    bills. With ``with_positions`` a 1-based ``pos`` inside (patient, section)
    is added from a global rank, so a patient with a huge history never
    becomes a single window partition.
    """
    money_null = F.lit(None).cast("decimal(10,2)")
    a = appts.select(
        "Patient_ID", F.lit("appointments").alias("section"), F.col("Appointment_ID").alias("record_id"),
        F.col("Appointment_Date").alias("event_date"), F.col("Appointment_Time").alias("event_time"),
        F.col("Department").alias("item"), F.col("Status").alias("status"),
        money_null.alias("Amount_Charged"), money_null.alias("Amount_Paid"),
        money_null.cast("decimal(11,2)").alias("Balance"))
    lt = labs.select(
        "Patient_ID", F.lit("lab_tests").alias("section"), F.col("Lab_Order_ID").alias("record_id"),
        F.col("Scheduled_Date").alias("event_date"), F.lit(None).cast("string").alias("event_time"),
        F.col("Test_Type").alias("item"), F.col("Result").alias("status"),
        money_null.alias("Amount_Charged"), money_null.alias("Amount_Paid"),
        money_null.cast("decimal(11,2)").alias("Balance"))
    b = bills.select(
        "Patient_ID", F.lit("billing").alias("section"), F.col("Bill_ID").alias("record_id"),
        F.col("Service_Date").alias("event_date"), F.lit(None).cast("string").alias("event_time"),
        F.col("Service_Type").alias("item"), F.col("Payment_Status").alias("status"),
        "Amount_Charged", "Amount_Paid",
        (F.col("Amount_Charged") - F.col("Amount_Paid")).cast("decimal(11,2)").alias("Balance"))
    rows = a.unionByName(lt).unionByName(b)
    if ids is not None:
        rows = rows.join(ids.select("Patient_ID").distinct(), "Patient_ID", "left_semi")
    section_order = (F.when(F.col("section") == "appointments", 1)
                     .when(F.col("section") == "lab_tests", 2).otherwise(3))
    order = ["Patient_ID", section_order, F.desc("event_date"), F.desc_nulls_last("event_time"), "record_id"]
    if not with_positions:
        return rows.orderBy(*order)
    ranked = global_rank(rows, order, "_rank")
    first = ranked.groupBy("Patient_ID", "section").agg(F.min("_rank").alias("_first"))
    return (
        ranked.join(first, ["Patient_ID", "section"])
        .withColumn("pos", (F.col("_rank") - F.col("_first") + 1).cast("bigint"))
        .drop("_rank", "_first")
    )
