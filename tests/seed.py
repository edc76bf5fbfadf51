"""Invented rows of the six tables under the documented keys."""

import datetime as dt
from decimal import Decimal

from medledger.sources import schemas as S

D = dt.date


def seed_tables(spark):
    patients = spark.createDataFrame([
        ("P1001", "John Smith", D(1980, 5, 15), "Male", "555-0101", "INS1001", "1 Main St"),
        ("P1002", "Mary Jones", D(1975, 8, 22), "Female", "555-0102", "INS1002", "2 Oak Ave"),
    ], S.PATIENT)
    doctors = spark.createDataFrame([
        ("D2001", "Dr. Adams", "Cardiology", "555-0201", "adams@example.org"),
        ("D2002", "Dr. Baker", "Neurology", "555-0202", "baker@example.org"),
    ], S.DOCTOR)
    appts = spark.createDataFrame([
        ("A3001", "P1001", "D2001", "Cardiology", D(2025, 6, 15), "10:00:00", "Scheduled"),
    ], S.APPOINTMENT)
    labs = spark.createDataFrame([
        ("L4001", "P1001", "Blood Test", D(2025, 6, 10), D(2025, 6, 12), "Pending"),
        ("L4002", "P1002", "X-Ray", D(2025, 6, 10), D(2025, 6, 20), "Pending"),
    ], S.LABTEST)
    rx = spark.createDataFrame([
        ("PR5001", "P1001", "D2001", D(2025, 6, 15), "Lisinopril", "20mg", "once daily"),
        ("PR5002", "P1002", "D2001", D(2025, 6, 25), "Aspirin", "81mg", "once daily"),
        ("PR5003", "P1002", "D2001", D(2025, 6, 26), "Aspirin", "81mg", "once daily"),
    ], S.PRESCRIPTION)
    bills = spark.createDataFrame([
        ("B6001", "P1001", "Consultation", D(2025, 6, 15), Decimal("200.00"), Decimal("0.00"), None, "Pending"),
    ], S.BILLING)
    return {"PATIENT": patients, "DOCTOR": doctors, "APPOINTMENT": appts, "LABTEST": labs,
            "PRESCRIPTION": rx, "BILLING": bills}
