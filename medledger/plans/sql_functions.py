"""SQL-callable form of the scalar billing function.

``CalculateOutstandingBill(patient_id)`` returns the Pending balance as
DECIMAL(10,2), 0.00 when there is none. It is a SQL function whose body is a
correlated scalar subquery; Catalyst decorrelates a call over a table of ids
into a left join to one pre-aggregated balance per patient, so calling it for
every patient is one aggregation, not one query per row.

``PatientReport(patient_id)`` is a table function: the patient's appointments, lab tests and bills in the report's long form.
Called with LATERAL for a table of ids it becomes one join.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_sql_functions(spark: SparkSession, bills_table: str) -> None:
    """(Re)register ``CalculateOutstandingBill`` over ``bills_table`` (table or view name)."""
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION CalculateOutstandingBill(in_Patient_ID STRING)
RETURNS DECIMAL(10,2)
RETURN SELECT CAST(COALESCE(SUM(Amount_Charged - Amount_Paid), 0.00) AS DECIMAL(10,2))
  FROM {bills_table}
  WHERE Patient_ID = in_Patient_ID AND Payment_Status = 'Pending'""")


def register_report_function(spark: SparkSession, report: str) -> None:
    """(Re)register ``PatientReport`` over ``report``, a view of ``reports.patient_report`` rows of all patients."""
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION PatientReport(in_Patient_ID STRING)
RETURNS TABLE(section STRING, record_id STRING, event_date DATE, event_time STRING, item STRING, status STRING,
  Amount_Charged DECIMAL(10,2), Amount_Paid DECIMAL(10,2), Balance DECIMAL(11,2))
RETURN SELECT section, record_id, event_date, event_time, item, status, Amount_Charged, Amount_Paid, Balance
  FROM {report} WHERE Patient_ID = in_Patient_ID""")
