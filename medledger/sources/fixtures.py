"""Driver test tables mapped onto the six clinical tables (DataFrame API).

The driver ships TPC-H-like parquet tables; these functions derive the
clinical tables from them so that every report's work grows with the input.
The same mapping as SQL text lives in ``fixture_sql`` for the DuckDB oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medledger.operators.ordering import global_rank
from medledger.sources.schemas import LENGTH_LIMITS, PRIMARY_KEYS, TABLES

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

def key_id(prefix: str, key: Column | str, width: int = 8) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(10,2)")


class Fixture:
    """Lazily built clinical views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def PATIENT(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(key_id("P", "c_custkey").alias("Patient_ID"), F.col("c_name").alias("Full_Name"))

    @cached_property
    def DOCTOR(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(key_id("D", "s_suppkey").alias("Doctor_ID"), F.col("s_name").alias("Full_Name"),
                    F.col("r_name").alias("Department"))
        )

    @cached_property
    def APPOINTMENT(self) -> DataFrame:
        """One appointment per event; the doctor is a deterministic hash of the event."""
        ev = self.raw("events")
        n_doctors = self.raw("supplier").select(F.count(F.lit(1))).scalar()
        doctor_key = (F.col("event_id") * 7919 + F.col("user_id") * 104729) % n_doctors
        status = (F.when(F.col("event_type") == "purchase", "Completed")
                  .when(F.col("event_type") == "error", "Canceled").otherwise("Scheduled"))
        a = ev.select(
            key_id("A", "event_id").alias("Appointment_ID"),
            key_id("P", "user_id").alias("Patient_ID"),
            key_id("D", doctor_key).alias("_doctor"),
            F.col("ts").cast("date").alias("Appointment_Date"),
            F.substring(F.col("ts").cast("string"), 12, 8).alias("Appointment_Time"),
            status.alias("Status"),
            F.col("event_id").alias("seq"),
            (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("int").alias("sec"),
        )
        # Same rows as joining the DOCTOR view, but each join input is a single scan,
        # so the planner's size estimates put the small side (supplier) in the broadcast.
        sup = self.raw("supplier").select(key_id("D", "s_suppkey").alias("Doctor_ID"), "s_nationkey")
        n, r = self.raw("nation"), self.raw("region")
        return (
            a.join(sup, a._doctor == sup.Doctor_ID)
            .join(n, F.col("s_nationkey") == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select("Appointment_ID", "Patient_ID", "Doctor_ID", F.col("r_name").alias("Department"),
                    "Appointment_Date", "Appointment_Time", "Status", "seq", "sec")
        )

    @cached_property
    def LABTEST(self) -> DataFrame:
        o = self.raw("orders")
        result = (F.when(F.col("o_orderstatus") == "P", "Pending")
                  .when(F.col("o_orderstatus") == "F", "Normal").otherwise("Abnormal"))
        return o.select(
            key_id("L", "o_orderkey").alias("Lab_Order_ID"),
            key_id("P", "o_custkey").alias("Patient_ID"),
            F.col("o_orderpriority").alias("Test_Type"),
            F.col("o_orderdate").cast("date").alias("Order_Date"),
            F.date_add(F.col("o_orderdate").cast("date"), 2).alias("Scheduled_Date"),
            result.alias("Result"),
        )

    @cached_property
    def PRESCRIPTION(self) -> DataFrame:
        li, o, p = self.raw("lineitem"), self.raw("orders"), self.raw("part")
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(
                F.concat(key_id("PR", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string"))
                .alias("Prescription_ID"),
                key_id("P", "o_custkey").alias("Patient_ID"),
                key_id("D", "l_suppkey").alias("Doctor_ID"),
                F.col("l_shipdate").cast("date").alias("Date_Issued"),
                F.col("p_name").alias("Medication_Name"),
                F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("mg")).alias("Dosage"),
            )
        )

    @cached_property
    def BILLING(self) -> DataFrame:
        o = self.raw("orders")
        charged = money("o_totalprice")
        st = F.col("o_orderstatus")
        paid = (F.when(st == "F", charged)
                .when(st == "O", (charged * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(10,2)"))
                .otherwise(F.lit(0).cast("decimal(10,2)")))
        return o.select(
            key_id("B", "o_orderkey").alias("Bill_ID"),
            key_id("P", "o_custkey").alias("Patient_ID"),
            F.concat(F.col("o_orderpriority"), F.lit(" Consultation")).alias("Service_Type"),
            F.col("o_orderdate").cast("date").alias("Service_Date"),
            charged.alias("Amount_Charged"),
            paid.alias("Amount_Paid"),
            F.when(st == "F", F.col("o_orderdate").cast("date")).alias("Payment_Date"),
            F.when(st == "F", "Paid").otherwise("Pending").alias("Payment_Status"),
        )

    @cached_property
    def VISIT_BILLING(self) -> DataFrame:
        """One Pending 200.00 bill per appointment, as booking creates them."""
        a = self.APPOINTMENT
        return a.select(
            key_id("B", "seq").alias("Bill_ID"),
            "Patient_ID",
            F.concat(F.col("Department"), F.lit(" Consultation")).alias("Service_Type"),
            F.col("Appointment_Date").alias("Service_Date"),
            F.lit(200).cast("decimal(10,2)").alias("Amount_Charged"),
            F.lit(0).cast("decimal(10,2)").alias("Amount_Paid"),
            F.lit(None).cast("date").alias("Payment_Date"),
            F.lit("Pending").alias("Payment_Status"),
            F.lit(1).alias("version"),
        )

    @cached_property
    def ACCOUNT_BILLING(self) -> DataFrame:
        """Bills charged from customer balances: negative balances break the billing rule."""
        c = self.raw("customer")
        return c.select(
            key_id("C", "c_custkey").alias("Bill_ID"),
            key_id("P", "c_custkey").alias("Patient_ID"),
            F.col("c_mktsegment").alias("Service_Type"),
            F.lit("2025-01-01").cast("date").alias("Service_Date"),
            money("c_acctbal").alias("Amount_Charged"),
            F.lit(0).cast("decimal(10,2)").alias("Amount_Paid"),
            F.lit(None).cast("date").alias("Payment_Date"),
            F.lit("Pending").alias("Payment_Status"),
        )

    @cached_property
    def ACCOUNT_VISIT_BILLING(self) -> DataFrame:
        """Visit bills charged with the patient's balance: negative ones break the billing rule."""
        balance = self.raw("customer").select(key_id("P", "c_custkey").alias("Patient_ID"), money("c_acctbal").alias("_charged"))
        v = self.VISIT_BILLING.join(balance, "Patient_ID")
        return v.select(*[(F.col("_charged") if c == "Amount_Charged" else F.col(c)).alias(c) for c in self.VISIT_BILLING.columns])

    @cached_property
    def ACCOUNT_PAYMENTS(self) -> DataFrame:
        """One payment per order on its customer's account bill; two in three expect a version of the bill,
        and amounts are large enough that some bills run out of range."""
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("seq"), key_id("C", "o_custkey").alias("Bill_ID"),
            (F.col("o_totalprice").cast("decimal(12,2)") * 40).cast("decimal(12,2)").cast("string").alias("amount"),
            F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("expected_version"))

    @cached_property
    def SHIFTED_REQUESTS(self) -> DataFrame:
        """A second set of calls: every appointment's patient and doctor again, 45 minutes later that day."""
        a = self.APPOINTMENT
        later = (F.col("sec") + 2700) % 86400
        text = F.concat_ws(":", *[F.lpad(x.cast("int").cast("string"), 2, "0") for x in (
            F.floor(later / 3600), F.floor(later % 3600 / 60), later % 60)])
        return a.select("seq", "Patient_ID", "Doctor_ID", F.col("Appointment_Date").cast("string").alias("Appointment_Date"),
                        text.alias("Appointment_Time"), "Department")

    @cached_property
    def FAULTY(self) -> dict[str, DataFrame]:
        """The six tables with every declared column and with faults: NULLs, orphans, over-long texts and
        amounts out of range, placed by arithmetic on the keys (see ``fixture_sql.faulty``)."""
        return {t: self._faulty(t) for t in TABLES}

    def _faulty(self, table: str) -> DataFrame:
        df = getattr(self, table)
        n = F.regexp_replace(PRIMARY_KEYS[table], "[^0-9]", "").cast("bigint")
        cols = []
        for i, f in enumerate(TABLES[table].fields):
            c = F.col(f.name) if f.name in df.columns else (
                F.lit("1980-02-03").cast("date") if f.name == "DOB" else F.lit(f"{f.name} text"))
            if f.name == PRIMARY_KEYS[table]:
                cols.append(c.alias(f.name))
                continue
            if f.name in ("Amount_Charged", "Amount_Paid"):
                c = F.when(n % 89 == i, F.lit(10**9).cast("decimal(14,2)")).otherwise(c.cast("decimal(14,2)"))
            elif f.name in ("Patient_ID", "Doctor_ID"):
                c = F.when(n % 83 == i, F.lit("X404")).otherwise(c)
            elif f.name in LENGTH_LIMITS[table]:
                c = F.when(n % 79 == i, F.repeat(F.lit("z"), LENGTH_LIMITS[table][f.name] + 1)).otherwise(c)
            cols.append(F.when(n % 97 != i, c).alias(f.name))
        return df.select(*cols)

    @cached_property
    def PAYMENTS(self) -> DataFrame:
        """One payment per line item against the bill of its order, in a fixed global order."""
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
        li = self.raw("lineitem").select(*order)
        # Texts are made of what is kept, behind the sort.
        ranked = global_rank(li, order, "seq", keep=["l_orderkey", "l_extendedprice"]).select(
            "seq", key_id("B", "l_orderkey").alias("Bill_ID"),
            F.col("l_extendedprice").cast("decimal(10,2)").cast("string").alias("amount"))
        return ranked.select("seq", "Bill_ID", "amount")

    @cached_property
    def STATUS_CHANGES(self) -> DataFrame:
        a = self.APPOINTMENT
        return a.where(F.col("Status") != "Scheduled").select(
            "seq", "Appointment_ID",
            F.when(F.col("Status") == "Completed", "complete").otherwise("cancel").alias("action"))

    @cached_property
    def BOOKING_REQUESTS(self) -> DataFrame:
        """Every appointment replayed as a booking call, in event order."""
        a = self.APPOINTMENT
        return a.select(
            "seq", "Patient_ID", "Doctor_ID",
            F.col("Appointment_Date").cast("string").alias("Appointment_Date"),
            "Appointment_Time", "Department")

    @cached_property
    def LAB_UPDATES(self) -> DataFrame:
        """One result update per order line for the lab test of its order, in a fixed global order."""
        li = self.raw("lineitem").select(
            key_id("L", "l_orderkey").alias("Lab_Order_ID"),
            F.when(F.col("l_returnflag") == "R", "Abnormal").when(F.col("l_returnflag") == "A", "Normal")
            .otherwise("Pending").alias("Result"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
            "l_returnflag",
        )
        ranked = global_rank(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                  "l_extendedprice", "l_shipdate", "l_returnflag"], "seq")
        return ranked.select("seq", "Lab_Order_ID", "Result")

    @cached_property
    def BOOKING_TEXT(self) -> DataFrame:
        """Booking calls as typed text: padded, unpadded, two-digit-year, short and blank fields."""
        a = self.APPOINTMENT
        st, d, sec = F.col("Status"), F.col("Appointment_Date"), F.col("sec")
        date_txt = (F.when(st == "Canceled", F.date_format(d, "yy-MM-dd"))
                    .when(st == "Completed", F.date_format(d, "y-M-d")).otherwise(d.cast("string")))
        unpadded = F.concat_ws(":", *[x.cast("string") for x in (F.floor(sec / 3600), F.floor(sec % 3600 / 60),
                                                                 sec % 60)])
        time_txt = (F.when(st == "Completed", unpadded)
                    .when(F.col("Department") == "EUROPE", F.substring("Appointment_Time", 1, 5))
                    .otherwise(F.col("Appointment_Time")))
        dept = F.when((st == "Scheduled") & (sec < 3600), F.lit("  ")).otherwise(F.col("Department"))
        return a.select("seq", "Patient_ID", "Doctor_ID", date_txt.alias("Appointment_Date"),
                        time_txt.alias("Appointment_Time"), dept.alias("Department"))

    @cached_property
    def PAYMENT_TEXT(self) -> DataFrame:
        """Payment calls as typed text: valid, negative and non-numeric amounts."""
        p = self.PAYMENTS
        value = F.col("amount").cast("decimal(10,2)")
        text = (F.when(value < 1000, F.concat(F.lit("-"), F.col("amount")))
                .when(value < 1100, F.lit("n/a")).otherwise(F.col("amount")))
        return p.select("seq", "Bill_ID", text.alias("amount"))

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("PATIENT", "DOCTOR", "APPOINTMENT", "LABTEST",
                                               "PRESCRIPTION", "BILLING")}
