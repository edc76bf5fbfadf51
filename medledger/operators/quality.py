"""Constraint audits and business-rule checks.

A Parquet table enforces no key, reference or CHECK rule, so each declared
constraint becomes an audit that returns the violating rows, and each
trigger becomes a rule for ``split_valid`` (accepted / rejected with message)
or ``enforce`` (fail the job like the trigger's SIGNAL).

Audit rows share one schema: (rule, table_name, column_name, key, detail).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medledger.functions.columns import (
    parse_amount, parse_date, parse_time_sec, sec_to_time, strip,
)

# The trigger messages of the schema.
NEGATIVE_BILLING_MESSAGE = "Negative billing amounts are not allowed."
PAST_APPOINTMENT_MESSAGE = "Cannot schedule an appointment in the past."


def _audit(df: DataFrame, rule: str, table: str, column: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     F.lit(column).alias("column_name"), key.cast("string").alias("key"),
                     detail.cast("string").alias("detail"))


def audit_primary_key(df: DataFrame, key: str, table: str = "") -> DataFrame:
    """Keys that repeat (one row per key with its count) and rows with a NULL key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull())
    rows = counts.withColumn("_rule", F.when(F.col(key).isNull(), "primary_key_null").otherwise("primary_key_duplicate"))
    return rows.select(F.col("_rule").alias("rule"), F.lit(table).alias("table_name"), F.lit(key).alias("column_name"),
                       F.col(key).cast("string").alias("key"), F.concat(F.col("_n").cast("string"), F.lit(" rows")).alias("detail"))


def audit_foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_key: str, child_key: str,
                      table: str = "") -> DataFrame:
    """Child rows whose non-NULL reference has no parent row: one anti join per reference.

    The child is read once; a value that many rows share is split by the adaptive
    skew join, and the parent side is one row per key.
    """
    parents = parent.select(F.col(parent_key).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    rows = child.where(F.col(column).isNotNull()).select(F.col(child_key).alias("_key"), F.col(column).alias("_ref"))
    orphans = rows.join(parents, rows["_ref"] == parents["_v"], "left_anti")
    return _audit(orphans, "foreign_key", table, column, F.col("_key"), F.col("_ref"))


def audit_not_null(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    """NULL count per declared NOT NULL column, in one pass (one row per column)."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    stacked = sums.unpivot([], list(columns), "column_name", "null_rows")
    return stacked.select(F.lit("not_null").alias("rule"), F.lit(table).alias("table_name"), "column_name",
                          F.coalesce(F.col("null_rows"), F.lit(0)).cast("bigint").alias("null_rows"))


def audit_lengths(df: DataFrame, limits: Mapping[str, int], key: str, table: str = "") -> DataFrame:
    """Rows whose text is longer than the declared VARCHAR(n), one row per (row, column).

    One scan: each row carries an array of its over-long columns, which is
    exploded (empty for a clean row).
    """
    checks = F.array(*[F.struct(F.lit(c).alias("c"), F.length(c).alias("n"), F.lit(n).alias("lim"))
                       for c, n in limits.items()])
    bad = df.select(F.col(key).alias("_key"), F.explode(F.filter(checks, lambda x: x["n"] > x["lim"])).alias("_v"))
    return bad.select(F.lit("length").alias("rule"), F.lit(table).alias("table_name"),
                      F.col("_v.c").alias("column_name"), F.col("_key").cast("string").alias("key"),
                      F.concat(F.col("_v.n").cast("string"), F.lit(" > "), F.col("_v.lim").cast("string"))
                      .alias("detail"))


def audit_decimals(df: DataFrame, columns: Sequence[str], key: str, precision: int = 10, scale: int = 2,
                   table: str = "") -> DataFrame:
    """Values that do not fit DECIMAL(precision, scale), in one scan."""
    target = f"decimal({precision},{scale})"
    checks = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"),
                                (F.col(c).isNotNull() & F.col(c).try_cast(target).isNull()).alias("bad"))
                       for c in columns])
    bad = df.select(F.col(key).alias("_key"), F.explode(F.filter(checks, lambda x: x["bad"])).alias("_v"))
    return bad.select(F.lit("decimal_range").alias("rule"), F.lit(table).alias("table_name"),
                      F.col("_v.c").alias("column_name"), F.col("_key").cast("string").alias("key"),
                      F.col("_v.v").alias("detail"))


@dataclass(frozen=True)
class Rule:
    """``violation`` is true for a bad row; NULL counts as passing (as in a trigger's IF)."""
    name: str
    violation: Column
    message: str


def tag_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule`` and ``message`` of the first failing rule (NULL when all pass)."""
    rule = message = None
    for r in reversed(rules):
        cond = F.coalesce(r.violation, F.lit(False))
        rule = F.when(cond, F.lit(r.name)) if rule is None else F.when(cond, F.lit(r.name)).otherwise(rule)
        message = (F.when(cond, F.lit(r.message)) if message is None
                   else F.when(cond, F.lit(r.message)).otherwise(message))
    return df.withColumn("rule", rule).withColumn("message", message)


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows passing every rule, rows failing one with ``rule`` and ``message``)."""
    tagged = tag_violations(df, rules)
    accepted = tagged.where(F.col("rule").isNull()).drop("rule", "message")
    rejected = tagged.where(F.col("rule").isNotNull())
    return accepted, rejected


def enforce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fail the query on the first violating row, like a trigger's SIGNAL."""
    out = df
    for r in rules:
        guard = F.when(F.coalesce(r.violation, F.lit(False)), F.raise_error(F.lit(r.message)))
        out = out.where(guard.isNull())
    return out


def billing_rules() -> list[Rule]:
    neg = (F.col("Amount_Charged") < 0) | (F.col("Amount_Paid") < 0)
    return [Rule("negative_amount", neg, NEGATIVE_BILLING_MESSAGE)]


def appointment_date_rules(as_of) -> list[Rule]:
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    return [Rule("past_date", F.col("Appointment_Date") < as_of_col, PAST_APPOINTMENT_MESSAGE)]


def check_billing(df: DataFrame, fail: bool = False):
    """Billing rule on inserts and updates: no negative charged or paid amount."""
    return enforce(df, billing_rules()) if fail else split_valid(df, billing_rules())


def check_appointment_date(df: DataFrame, as_of: str | dt.date | Column, fail: bool = False):
    """Appointment rule on inserts: the date may not lie before ``as_of``."""
    rules = appointment_date_rules(as_of)
    return enforce(df, rules) if fail else split_valid(df, rules)


# ------------------------------------------------------------ request validation

# The console client's messages.
MSG_ALL_REQUIRED = "All fields are required"
MSG_BAD_DATE = "Invalid date format. Use YYYY-MM-DD"
MSG_BAD_TIME = "Invalid time format. Use HH:MM:SS"
MSG_BAD_AMOUNT = "Invalid amount"
MSG_NOT_POSITIVE = "Invalid amount: Amount must be positive"
MSG_BOTH_REQUIRED = "Both fields are required"

BOOKING_FIELDS = ["Patient_ID", "Doctor_ID", "Appointment_Date", "Appointment_Time", "Department"]


def checked_booking(df: DataFrame) -> DataFrame:
    """Booking calls with their stripped fields (``_`` and the name), ``_date``, ``_sec`` and ``error`` (NULL: valid)."""
    s = df.select("*", *[strip(c).alias(f"_{c}") for c in BOOKING_FIELDS])
    s = s.withColumn("_date", parse_date("_Appointment_Date", stripped=True)).withColumn(
        "_sec", parse_time_sec("_Appointment_Time", stripped=True))
    present = [F.coalesce(F.length(f"_{c}") > 0, F.lit(False)) for c in BOOKING_FIELDS]
    error = (F.when(~reduce(lambda a, b: a & b, present),
                    F.lit(MSG_ALL_REQUIRED))
             .when(F.col("_date").isNull(), F.lit(MSG_BAD_DATE))
             .when(F.col("_sec").isNull(), F.lit(MSG_BAD_TIME)))
    return s.withColumn("error", error)


def validate_requests(df: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """Client-side checks as set-based columns: (valid rows, invalid rows with ``error``).

    ``spec`` is ``booking``, ``payment`` or ``lab_update``. Text fields are
    stripped; the first failing check wins, in the client's order.
    """
    if spec == "booking":
        s = checked_booking(df)
        valid = s.where(F.col("error").isNull()).select(
            "seq", F.col("_Patient_ID").alias("Patient_ID"), F.col("_Doctor_ID").alias("Doctor_ID"),
            F.col("_date").alias("Appointment_Date"), sec_to_time("_sec").alias("Appointment_Time"),
            F.col("_sec").alias("sec"), F.col("_Department").alias("Department"))
        invalid = s.where(F.col("error").isNotNull()).select(
            "seq", *[F.col(c) for c in BOOKING_FIELDS], "error")
        return valid, invalid
    if spec == "payment":
        s = df.withColumn("_bill", strip("Bill_ID")).withColumn("_amount", parse_amount("amount"))
        error = (F.when(F.col("_amount").isNull(), F.lit(MSG_BAD_AMOUNT))
                 .when(F.col("_amount") <= 0, F.lit(MSG_NOT_POSITIVE)))
        s = s.withColumn("error", error)
        valid = s.where(F.col("error").isNull()).select(
            "seq", F.col("_bill").alias("Bill_ID"), F.col("_amount").alias("amount"),
            *(c for c in ("expected_version",) if c in df.columns))
        invalid = s.where(F.col("error").isNotNull()).select("seq", "Bill_ID", "amount", "error")
        return valid, invalid
    if spec == "lab_update":
        s = df.withColumn("_id", strip("Lab_Order_ID")).withColumn("_res", strip("Result"))
        present = F.coalesce((F.length("_id") > 0) & (F.length("_res") > 0), F.lit(False))
        error = F.when(~present, F.lit(MSG_BOTH_REQUIRED))
        s = s.withColumn("error", error)
        valid = s.where(F.col("error").isNull()).select(
            "seq", F.col("_id").alias("Lab_Order_ID"), F.col("_res").alias("Result"))
        invalid = s.where(F.col("error").isNotNull()).select("seq", "Lab_Order_ID", "Result", "error")
        return valid, invalid
    raise ValueError(f"unknown request spec {spec!r}")
