"""Declared schemas of the six clinical tables and the request tables.

Every column is NOT NULL except ``BILLING.Payment_Date`` and the ``version``
columns added at run time. ``VARCHAR(n)`` becomes ``StringType`` plus a length
limit in ``LENGTH_LIMITS``; ``TIME`` is kept as ``'HH:mm:ss'`` text.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DateType()
MONEY = T.DecimalType(10, 2)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# The declared columns of the six tables.
PATIENT = _schema(
    ("Patient_ID", S, False), ("Full_Name", S, False), ("DOB", D, False), ("Gender", S, False),
    ("Contact_Number", S, False), ("Insurance_Number", S, False), ("Address", S, False),
)
DOCTOR = _schema(
    ("Doctor_ID", S, False), ("Full_Name", S, False), ("Department", S, False),
    ("Contact_Number", S, False), ("Email", S, False),
)
APPOINTMENT = _schema(
    ("Appointment_ID", S, False), ("Patient_ID", S, False), ("Doctor_ID", S, False), ("Department", S, False),
    ("Appointment_Date", D, False), ("Appointment_Time", S, False), ("Status", S, False),
)
LABTEST = _schema(
    ("Lab_Order_ID", S, False), ("Patient_ID", S, False), ("Test_Type", S, False), ("Order_Date", D, False),
    ("Scheduled_Date", D, False), ("Result", S, False),
)
PRESCRIPTION = _schema(
    ("Prescription_ID", S, False), ("Patient_ID", S, False), ("Doctor_ID", S, False), ("Date_Issued", D, False),
    ("Medication_Name", S, False), ("Dosage", S, False), ("Frequency", S, False),
)
BILLING = _schema(
    ("Bill_ID", S, False), ("Patient_ID", S, False), ("Service_Type", S, False), ("Service_Date", D, False),
    ("Amount_Charged", MONEY, False), ("Amount_Paid", MONEY, False), ("Payment_Date", D, True),
    ("Payment_Status", S, False),
)

TABLES: dict[str, T.StructType] = {
    "PATIENT": PATIENT,
    "DOCTOR": DOCTOR,
    "APPOINTMENT": APPOINTMENT,
    "LABTEST": LABTEST,
    "PRESCRIPTION": PRESCRIPTION,
    "BILLING": BILLING,
}

PRIMARY_KEYS: dict[str, str] = {
    "PATIENT": "Patient_ID",
    "DOCTOR": "Doctor_ID",
    "APPOINTMENT": "Appointment_ID",
    "LABTEST": "Lab_Order_ID",
    "PRESCRIPTION": "Prescription_ID",
    "BILLING": "Bill_ID",
}

# (child table, column, parent table, parent key)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("APPOINTMENT", "Patient_ID", "PATIENT", "Patient_ID"),
    ("APPOINTMENT", "Doctor_ID", "DOCTOR", "Doctor_ID"),
    ("LABTEST", "Patient_ID", "PATIENT", "Patient_ID"),
    ("PRESCRIPTION", "Patient_ID", "PATIENT", "Patient_ID"),
    ("PRESCRIPTION", "Doctor_ID", "DOCTOR", "Doctor_ID"),
    ("BILLING", "Patient_ID", "PATIENT", "Patient_ID"),
]

# Declared VARCHAR lengths of the schema.
LENGTH_LIMITS: dict[str, dict[str, int]] = {
    "PATIENT": {"Patient_ID": 10, "Full_Name": 100, "Gender": 10, "Contact_Number": 15,
                "Insurance_Number": 20, "Address": 200},
    "DOCTOR": {"Doctor_ID": 10, "Full_Name": 100, "Department": 50, "Contact_Number": 15, "Email": 100},
    "APPOINTMENT": {"Appointment_ID": 10, "Patient_ID": 10, "Doctor_ID": 10, "Department": 50, "Status": 20},
    "LABTEST": {"Lab_Order_ID": 10, "Patient_ID": 10, "Test_Type": 50, "Result": 20},
    "PRESCRIPTION": {"Prescription_ID": 10, "Patient_ID": 10, "Doctor_ID": 10, "Medication_Name": 100,
                     "Dosage": 50, "Frequency": 100},
    "BILLING": {"Bill_ID": 10, "Patient_ID": 10, "Service_Type": 100, "Payment_Status": 20},
}

# DECIMAL(10,2) money columns.
DECIMAL_COLUMNS: dict[str, list[str]] = {"BILLING": ["Amount_Charged", "Amount_Paid"]}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]


# Request tables: one row per call of a routine; ``seq`` orders the calls.
BOOKING_REQUESTS = _schema(
    ("seq", T.LongType(), False), ("Patient_ID", S, True), ("Doctor_ID", S, True),
    ("Appointment_Date", S, True), ("Appointment_Time", S, True), ("Department", S, True),
)
PAYMENTS = _schema(("seq", T.LongType(), False), ("Bill_ID", S, True), ("amount", S, True),
                   ("expected_version", T.IntegerType(), True))
STATUS_CHANGES = _schema(("seq", T.LongType(), False), ("Appointment_ID", S, True), ("action", S, True))
LAB_UPDATES = _schema(("seq", T.LongType(), False), ("Lab_Order_ID", S, True), ("Result", S, True))
