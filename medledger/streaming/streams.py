"""Structured Streaming forms of the triggers and routines.

The reference enforces its rules per row as data arrives (triggers) and
books or pays one call at a time. On a stream each micro-batch is handed to
the batch operator with ``foreachBatch``:

* ``check_billing_stream`` / ``check_appointment_stream``: the trigger rules
  split each micro-batch into accepted and rejected rows (with message).
* ``booking_stream`` / ``payment_stream``: each micro-batch of requests is
  decided against the current state, and only the rows it adds or changes are
  written (append-only for booking, merge-on-read updates for payments). The
  initial tables are filtered by what the batch asks for (dates, keys), which
  a scan of them still reads unless they are partitioned or sorted that way.

A call has one outcome, whatever batch it arrives in: a call whose ``seq`` an earlier
batch has decided (or that arrives twice in one batch) is not carried out again, and is
written to ``out/repeated/batch_id=<n>`` instead. A call that arrives after a batch with a
larger ``seq`` is decided when it arrives, behind that batch, and marked ``late`` in its outcome.
Two different calls of one ``seq`` in one batch stop the stream.

Every output folder carries the batch id, and a replayed batch overwrites
its own folder, so a restart after a failure is idempotent. Checkpoints live
under the session's ``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from medledger.operators import booking as BK
from medledger.operators import changes as C
from medledger.operators import quality as Q
from medledger.operators.ordering import ordered_requests, unique_seq
from medledger.sources import schemas as S
from medledger.session import cut_lineage, ensure_checkpoint_dir, intermediate_tables


def _checkpoint_location(spark: SparkSession, name: str, location: str | None) -> str:
    return location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _source(spark: SparkSession, schema: T.StructType, path: str, max_files_per_trigger: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _start(src: DataFrame, fn: Callable[[DataFrame, int], None], name: str, checkpoint: str | None,
           available_now: bool) -> StreamingQuery:
    w = src.writeStream.foreachBatch(fn).option("checkpointLocation",
                                                 _checkpoint_location(src.sparkSession, name, checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _split_writer(rules: list[Q.Rule], accepted_path: str, rejected_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        tagged = Q.tag_violations(batch, rules).persist()
        try:
            tagged.where("rule IS NULL").drop("rule", "message").write.mode("overwrite").parquet(
                f"{accepted_path}/batch_id={batch_id}")
            tagged.where("rule IS NOT NULL").write.mode("overwrite").parquet(f"{rejected_path}/batch_id={batch_id}")
        finally:
            tagged.unpersist()
    return write


def check_billing_stream(spark: SparkSession, source: str, accepted: str, rejected: str,
                         checkpoint: str | None = None, schema: T.StructType = S.BILLING,
                         available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Billing rule on arriving bill rows (parquet files under ``source``)."""
    src = _source(spark, schema, source, max_files_per_trigger)
    return _start(src, _split_writer(Q.billing_rules(), accepted, rejected), "billing", checkpoint, available_now)


def check_appointment_stream(spark: SparkSession, source: str, accepted: str, rejected: str, as_of,
                             checkpoint: str | None = None, schema: T.StructType = S.APPOINTMENT,
                             available_now: bool = True, max_files_per_trigger: int | None = None
                             ) -> StreamingQuery:
    """Past-date rule on arriving appointment rows."""
    src = _source(spark, schema, source, max_files_per_trigger)
    return _start(src, _split_writer(Q.appointment_date_rules(as_of), accepted, rejected), "appointments",
                  checkpoint, available_now)


def _earlier_batches(spark: SparkSession, root: str, batch_id: int, schema: T.StructType, since: int = 0) -> DataFrame:
    """Rows written by batches from ``since`` and before ``batch_id`` under ``root/batch_id=<n>`` (a replayed
    batch never sees its own earlier attempt)."""
    with_batch = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType(), True)])
    return spark.read.schema(with_batch).parquet(root).where(F.col("batch_id").between(since, batch_id - 1))


_SPAN = "low bigint, high bigint"


def _new_calls(spark: SparkSession, batch: DataFrame, out: str, batch_id: int,
               store: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, int | None]:
    """The calls of a batch that no earlier batch has decided (a table of unique ``seq``, as ``store`` keeps it), and the largest ``seq`` decided before.

    The batch is stored once, in the form in which it is decided. Every batch leaves the span of its ``seq`` values (one row), so outcomes of earlier batches are read only
    where their span meets this batch's: none, as long as calls arrive in order.
    """
    held = store(batch)
    if not unique_seq(held):  # only then do all columns, as typed, need a shuffle
        batch = ordered_requests(batch.distinct(), "calls of one batch")
        held = store(batch)
    low, high = held.agg(F.min("seq"), F.max("seq")).first()
    top, meets = None, []
    if batch_id > 0:
        spans = _earlier_batches(spark, f"{out}/spans", batch_id, T.StructType.fromDDL(_SPAN)).where("low IS NOT NULL")
        top = spans.agg(F.max("high")).first()[0]
        if low is not None:
            meets = [r["batch_id"] for r in spans.where((F.col("low") <= high) & (F.col("high") >= low)).select("batch_id").collect()]
    spark.createDataFrame([(low, high)], _SPAN).coalesce(1).write.mode("overwrite").parquet(f"{out}/spans/batch_id={batch_id}")
    new = held
    if meets:
        decided = spark.read.schema("seq bigint").parquet(*[f"{out}/outcome/batch_id={k}" for k in meets]).distinct()
        batch.join(decided, "seq", "left_semi").write.mode("overwrite").parquet(f"{out}/repeated/batch_id={batch_id}")
        new = cut_lineage(held.join(decided, "seq", "left_anti"))
    return new, top


def _write_outcome(outcome: DataFrame, top: int | None, out: str, batch_id: int) -> DataFrame:
    """Write a batch's outcome, with ``late`` added, and read it back."""
    late = F.lit(False) if top is None else F.coalesce(F.col("seq") < F.lit(top), F.lit(False))
    outcome = outcome.withColumn("late", late)
    outcome.write.mode("overwrite").parquet(f"{out}/outcome/batch_id={batch_id}")
    return outcome.sparkSession.read.schema(outcome.schema).parquet(f"{out}/outcome/batch_id={batch_id}")


_TOPS = "appointment bigint, bill bigint"


def booking_stream(spark: SparkSession, requests: str, appts: DataFrame, bills: DataFrame, patients: DataFrame,
                   doctors: DataFrame, out: str, as_of=None, distinct_codes: bool = False,
                   checkpoint: str | None = None, available_now: bool = True,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Booking calls arriving as files; each micro-batch is decided in ``seq`` order
    against the initial tables plus everything booked by earlier batches.

    A batch writes just its new rows (``out/appointments_added/batch_id=<n>``, by date, and
    ``out/bills_added/...``), its outcome, and the largest ids so far (``out/tops/...``), which the
    next batch reads instead of the tables. Of the appointments it reads the dates of its requests
    only (a filter on the initial table, partitions of the added rows), of patients and doctors
    the keys it asks for. Its intermediate tables are removed when it ends.
    """
    src = _source(spark, S.BOOKING_REQUESTS, requests, max_files_per_trigger)

    def decide(batch: DataFrame, batch_id: int) -> None:
        with intermediate_tables(spark):
            calls, top = _new_calls(spark, batch, out, batch_id, BK.checked_calls)
            book = appts
            if batch_id > 0:
                added = _earlier_batches(spark, f"{out}/appointments_added", batch_id, _added_schema(appts))
                book = appts.unionByName(added.drop("batch_id"), allowMissingColumns=True)
                tops = tuple(spark.read.schema(_TOPS).parquet(f"{out}/tops/batch_id={batch_id - 1}").first())
            else:
                tops = (BK.top_id(appts, "Appointment_ID", "A"), BK.top_id(bills, "Bill_ID", "B"))
            added_a, added_b, outcome = BK.book_new_rows(book, bills, patients, doctors, calls, as_of=as_of,
                                                         distinct_codes=distinct_codes, tops=tops, held=True)
            decided = _write_outcome(outcome, top, out, batch_id)
            added_a.write.mode("overwrite").partitionBy("Appointment_Date").parquet(
                f"{out}/appointments_added/batch_id={batch_id}")
            added_b.write.mode("overwrite").parquet(f"{out}/bills_added/batch_id={batch_id}")
            booked = decided.where("status = 0").count()
            spark.createDataFrame([(tops[0] + booked, tops[1] + booked)], _TOPS).coalesce(1).write.mode("overwrite").parquet(
                f"{out}/tops/batch_id={batch_id}")

    return _start(src, decide, "booking", checkpoint, available_now)


def _added_schema(table: DataFrame) -> T.StructType:
    """Schema of rows booking appends to ``table`` (its columns plus ``version``)."""
    fields = [f for f in table.schema.fields]
    if "version" not in table.columns:
        fields.append(T.StructField("version", T.IntegerType(), True))
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


#: Every so many batches the bill updates so far are merged into one table.
COMPACT_EVERY = 16


def current_bills(spark: SparkSession, bills: DataFrame, out: str, batch_id: int | None = None) -> DataFrame:
    """Bills as left by ``payment_stream``: the initial table overlaid with the latest
    update of each changed bill (from batches before ``batch_id``, or all)."""
    latest = _latest_updates(spark, bills, out, batch_id)
    j = bills.join(latest, "Bill_ID", "left")
    return j.select(*[(F.col(c) if c == "Bill_ID" else
                       F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c))).alias(c)
                      for c in bills.columns])


def _latest_updates(spark: SparkSession, bills: DataFrame, out: str, batch_id: int | None) -> DataFrame:
    """(Bill_ID, _u: its latest row) from the last merged table before ``batch_id`` and the batches since."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in bills.schema.fields])
    since = 0 if batch_id is None else batch_id // COMPACT_EVERY * COMPACT_EVERY
    ups = _earlier_batches(spark, f"{out}/bill_updates", (1 << 62) if batch_id is None else batch_id, schema, since)
    if since:
        merged = spark.read.schema(schema).parquet(f"{out}/bill_updates_merged/before={since}")
        ups = ups.unionByName(merged.withColumn("batch_id", F.lit(-1).cast("bigint")))
    return ups.groupBy("Bill_ID").agg(F.max_by(F.struct(*bills.columns), "batch_id").alias("_u"))


def payment_stream(spark: SparkSession, payments: str, bills: DataFrame, out: str, use_version: bool | None = None,
                   checkpoint: str | None = None, available_now: bool = True,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Payment calls arriving as files, applied per micro-batch in ``seq`` order.

    A batch writes only the bills it changed (``out/bill_updates/batch_id=<n>``) and
    its outcome; ``current_bills`` overlays the latest update per bill on the initial
    table (merge on read), so no batch rewrites the whole bills table. It reads the
    bills that its payments name, and merged updates instead of the whole history. Its
    intermediate tables are removed when it ends.
    """
    src = _source(spark, S.PAYMENTS, payments, max_files_per_trigger)
    base = bills if not use_version or "version" in bills.columns else bills.withColumn("version", F.lit(1))

    def apply(batch: DataFrame, batch_id: int) -> None:
        with intermediate_tables(spark):
            calls, top = _new_calls(spark, batch, out, batch_id)
            asked = calls.select(F.trim("Bill_ID").alias("Bill_ID")).distinct()
            cur = base.join(asked, "Bill_ID", "left_semi")
            cur = cut_lineage(cur if batch_id == 0 else current_bills(spark, cur, out, batch_id))
            new_b, outcome = C.apply_payments(cur, calls, use_version=use_version, held=True)
            touched = _write_outcome(outcome, top, out, batch_id).where("ok").select("Bill_ID").distinct()
            new_b.select(*base.columns).join(touched, "Bill_ID", "left_semi").write.mode("overwrite").parquet(
                f"{out}/bill_updates/batch_id={batch_id}")
            if (batch_id + 1) % COMPACT_EVERY == 0:
                # Later batches read this instead of the batches it merges.
                before = _latest_updates(spark, base, out, batch_id)
                now = spark.read.schema(base.schema).parquet(f"{out}/bill_updates/batch_id={batch_id}")
                kept = before.join(now, "Bill_ID", "left_anti").select("_u.*")
                kept.unionByName(now).write.mode("overwrite").parquet(f"{out}/bill_updates_merged/before={batch_id + 1}")

    return _start(src, apply, "payments", checkpoint, available_now)
