"""Appointment booking: 30-minute slot conflicts, ordered acceptance, new ids.

The stored routine books one request at a time: a request is refused when
an appointment of the same patient, or else of the same doctor, lies on the
same date less than 30 minutes away; otherwise it is inserted (and may still
fail the past-date rule or a missing patient/doctor, which then blocks no
later request). Here a whole ordered batch is decided at once.

Scale design
------------
* No pair lists. Time of day is discrete (86,400 seconds), so every
  neighbourhood test is a range window over per-(key, date, second)
  aggregates: at most 86,400 rows per window partition however hot a
  patient or doctor is, and the aggregates are combined map-side.
* A request with no other and no existing appointment in its windows is settled at once (``_sift``, one
  window per key over the whole batch); one with an existing appointment there is rejected. The rounds see the others.
* Acceptance runs in rounds. A pending request is rejected once an accepted
  appointment lies in its window, and accepted once nothing earlier
  that is undecided does. Within a round, requests that are contested on one
  key only (no undecided neighbour on the other) are decided in one pass over
  that key and date in ``seq`` order, so a whole day of one doctor settles in
  one round however long its chain. The pass
  sees the smallest ``seq`` of each second: at most 86,400 rows per key and date; a task
  streams through many days (about ``ROWS_PER_PASS`` requests), none of them a group of its own.
* Chains that keep changing between doctors and patients are settled by pointer doubling
  (``_settle_chains``): a request with exactly one earlier undecided neighbour has the opposite
  outcome of it, so jumps twice as far each time reach a decided request in logarithmically many steps.
  Requests with several earlier undecided neighbours wait for the next round.
  Each round's state is written as a Parquet table, which cuts the lineage.
* Existing appointments are cut to the dates of the requests (a literal range
  that reaches the scan) and summed per (key, date, second), as the requests are, before the window, so a
  hot key-date travels as at most 86,400 rows of each map task.
* The final status of every request is recomputed from the accepted set
  ("is there an earlier accepted or existing appointment in my window?"),
  which is exactly the sequential rule.
* New ids: dense ranks in ``seq`` order from ``global_rank``.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medledger.functions.columns import format_id, id_number, sec_to_time, time_of_day_sec
from medledger.operators.ordering import global_rank, ordered_requests, unique_seq
from medledger.operators.quality import PAST_APPOINTMENT_MESSAGE, checked_booking, validate_requests
from medledger.session import cut_lineage

# Outcome texts.
MSG_BOOKED = "Appointment booked successfully. ID: "
MSG_SLOT_TAKEN = "Booking failed - time slot not available"
MSG_MISSING_PARENT = "Cannot add or update a child row: a foreign key constraint fails"

_EARLIEST = -(1 << 63)

#: Pending requests that one task passes in a round.
ROWS_PER_PASS = 50_000


def _window(key: str, minutes: int):
    reach = minutes * 60 - 1  # |a - b| < minutes*60 seconds
    return Window.partitionBy(key, "_date").orderBy("_sec").rangeBetween(-reach, reach)


def slot_conflicts(appts: DataFrame, minutes: int = 30) -> DataFrame:
    """Appointments that have others of the same patient or doctor on the same
    date less than ``minutes`` apart, with the number of such others per key."""
    sec = F.col("sec") if "sec" in appts.columns else time_of_day_sec("Appointment_Time")
    a = appts.withColumn("_date", F.col("Appointment_Date")).withColumn("_sec", sec.cast("int"))
    out = a
    for key, name in (("Patient_ID", "patient_conflicts"), ("Doctor_ID", "doctor_conflicts")):
        per_sec = a.groupBy(key, "_date", "_sec").agg(F.count(F.lit(1)).alias("_n"))
        near = per_sec.select(key, "_date", "_sec", F.sum("_n").over(_window(key, minutes)).alias(name))
        out = out.join(near, [key, "_date", "_sec"])
        out = out.withColumn(name, (F.col(name) - 1).cast("bigint"))
    return out.where((F.col("patient_conflicts") > 0) | (F.col("doctor_conflicts") > 0)).select(
        "Appointment_ID", "Patient_ID", "Doctor_ID", "Appointment_Date", "Appointment_Time",
        "patient_conflicts", "doctor_conflicts")


def top_id(existing: DataFrame, id_col: str, prefix: str) -> int:
    """Largest numeric id suffix in ``existing`` (0 when none)."""
    return existing.agg(F.coalesce(F.max(id_number(id_col, len(prefix))), F.lit(0))).first()[0]


def top_id_number(existing: DataFrame, id_col: str, prefix: str) -> Column:
    """Largest numeric id suffix in ``existing`` (0 when none), as a lazy scalar subquery."""
    return existing.select(F.coalesce(F.max(id_number(id_col, len(prefix))), F.lit(0)).alias("_top")).scalar()


def next_ids(existing: DataFrame, id_col: str, new: DataFrame, order: str, prefix: str, out: str,
             width: int = 4) -> DataFrame:
    """Give each row of ``new`` the id ``prefix`` + (largest numeric suffix in
    ``existing`` + its rank by ``order``), zero-padded to at least ``width``
    and never truncated."""
    ranked = global_rank(new, [order], "_rank")
    top = top_id_number(existing, id_col, prefix)
    return ranked.withColumn(out, format_id(prefix, top + F.col("_rank"), width)).drop("_rank")


def _keys_missing(tables: dict[str, DataFrame], requests: DataFrame) -> DataFrame:
    """The distinct (_key: column, _v: value) of the requests that the table of that key lacks, found in one job:
    few as a rule, so the requests need no shuffle to meet them."""
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("_key"), F.col(c).alias("_v")) for c in tables]))
    asked = requests.select(keys.alias("_k")).select("_k.*").where("_v IS NOT NULL").distinct()
    known = _union([df.select(F.lit(c).alias("_key"), F.col(c).alias("_v")) for c, df in tables.items()])
    return cut_lineage(asked.join(known, ["_key", "_v"], "left_anti"))


# The blocking table holds existing and accepted appointments for both keys:
# (_kt: "p" patient / "d" doctor, _kv: key value, _date, _sec, _acc: count, _aseq: smallest seq).
_KEY_TYPES = (("p", "Patient_ID"), ("d", "Doctor_ID"))


def _by_key(rows: DataFrame, acc: Column, aseq: Column) -> DataFrame:
    """Rows (Patient_ID, Doctor_ID, _date, _sec) as blocking entries for both keys."""
    parts = [rows.select(F.lit(kt).alias("_kt"), F.col(key).alias("_kv"), "_date", "_sec",
                         acc.cast("bigint").alias("_acc"), aseq.cast("bigint").alias("_aseq"))
             for kt, key in _KEY_TYPES]
    return parts[0].unionByName(parts[1])


def _live(pending: DataFrame) -> DataFrame:
    """(_kt, _kv, _date) touched by pending requests."""
    return _by_key(pending, F.lit(0), F.lit(0)).select("_kt", "_kv", "_date").distinct()


def _existing_blocking(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Existing appointments per (key, date, second), only in key-dates that have requests."""
    e = _by_key(existing, F.lit(1), F.lit(_EARLIEST))
    e = e.groupBy("_kt", "_kv", "_date", "_sec").agg(F.sum("_acc").alias("_acc"), F.min("_aseq").alias("_aseq"))
    return e.join(_live(requests), ["_kt", "_kv", "_date"], "left_semi")


def _existing(appts: DataFrame, requests: DataFrame) -> DataFrame:
    """The appointments on the dates that the requests span."""
    lo, hi = requests.agg(F.min("_date"), F.max("_date")).first()
    sec = F.col("sec") if "sec" in appts.columns else time_of_day_sec("Appointment_Time")
    near = appts.where(F.col("Appointment_Date").between(F.lit(lo), F.lit(hi))) if lo else appts.limit(0)
    return near.select("Patient_ID", "Doctor_ID", F.col("Appointment_Date").alias("_date"), sec.cast("int").alias("_sec"))


def request_conflicts(appts: DataFrame, requests: DataFrame, minutes: int = 30) -> DataFrame:
    """Per valid request: how many stored appointments of its patient and of its doctor are less than
    ``minutes`` away on its date, and the reason for which it would be refused (the patient's come first)."""
    valid, _ = validate_requests(ordered_requests(requests, "booking requests"), "booking")
    req = cut_lineage(valid.select("seq", "Patient_ID", "Doctor_ID", F.col("Appointment_Date").alias("_date"),
                                   F.col("sec").alias("_sec")))
    blocking = _existing_blocking(_existing(appts, req), req)
    out = req
    for (kt, key), name in zip(_KEY_TYPES, ("patient_conflicts", "doctor_conflicts")):
        near = _near(req.select(key, "_date", "_sec"), blocking, kt, key, minutes, [F.sum("_acc").alias("_acc")],
                     [(F.sum, "_acc", name)])
        out = out.join(near, [key, "_date", "_sec"]).withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    reason = F.when(F.col("patient_conflicts") > 0, "patient").when(F.col("doctor_conflicts") > 0, "doctor")
    return out.select("seq", "patient_conflicts", "doctor_conflicts", reason.alias("reason"))


def _near(points: DataFrame, blocking: DataFrame, kt: str, key: str, minutes: int, aggs, outs) -> DataFrame:
    """Window summaries per (key, date, second) over request points and blocking rows of one key type."""
    b = blocking.where(F.col("_kt") == kt).select(F.col("_kv").alias(key), "_date", "_sec", "_acc", "_aseq")
    pts = points.unionByName(b, allowMissingColumns=True)
    per_sec = pts.groupBy(key, "_date", "_sec").agg(*aggs)
    w = _window(key, minutes)
    return per_sec.select(key, "_date", "_sec", *[f(c).over(w).alias(o) for f, c, o in outs])


def checked_calls(requests: DataFrame) -> DataFrame:
    """The calls of a batch, stored once: fields are checked in the job that materialises them.

    A valid call (``error`` is NULL) keeps its stripped fields, date and second (the time as text follows from the
    second), an invalid one its fields as typed.
    """
    s = checked_booking(requests)
    ok = F.col("error").isNull()
    texts = [F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("Patient_ID", "Doctor_ID", "Department")]
    return cut_lineage(s.select("seq", *texts, "_date", "_sec", F.when(~ok, F.col("Appointment_Time")).alias("Appointment_Time"), "error"))


def _valid_and_invalid(requests: DataFrame, held: bool) -> tuple[DataFrame, DataFrame]:
    """The valid and the invalid calls of a batch. ``seq`` must be a total order: the routine handles one call at a time."""
    stored = requests if held else checked_calls(requests)
    if not held and not unique_seq(stored):
        raise ValueError("booking requests need unique seq values")
    return (stored.where("error IS NULL").select("seq", "Patient_ID", "Doctor_ID", "_date", "_sec", "Department"),
            stored.where("error IS NOT NULL").select("seq", "Patient_ID", "Doctor_ID", "Appointment_Time", "error"))


def _sift(valid: DataFrame, req: DataFrame, existing: DataFrame, minutes: int) -> DataFrame:
    """The requests ``req`` (``valid`` and what is known of them) with ``_busy0`` / ``_busy1`` (an existing appointment in reach, per key) and ``_alone`` (nothing
    existing and no other request in reach on either key: what becomes of it concerns no other request).

    One window for both keys over requests and existing appointments (each read once), summed per second. Seconds
    with no other second in reach are left out by their neighbours first: they add to nobody's sums, and only the
    rest takes the frames of an hour. Only seconds that are not alone meet the requests again.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(key).alias("v")) for i, (_, key) in enumerate(_KEY_TYPES)]))
    points = [rows.select(keys.alias("_k"), "_date", "_sec", F.lit(r).alias("_r"), F.lit(1 - r).alias("_e"))
              for rows, r in ((valid, 1), (existing, 0))]
    per_sec = points[0].unionByName(points[1]).groupBy(F.col("_k.i").alias("_i"), F.col("_k.v").alias("_kv"), "_date", "_sec").agg(
        F.sum("_r").alias("_r"), F.sum("_e").alias("_e"))
    reach = minutes * 60 - 1
    in_order = Window.partitionBy("_i", "_kv", "_date").orderBy("_sec")
    w = in_order.rangeBetween(-reach, reach)
    per_sec = per_sec.select("*", F.lag("_sec").over(in_order).alias("_before"), F.lead("_sec").over(in_order).alias("_after"))
    per_sec = per_sec.where(f"_sec - _before <= {reach} OR _after - _sec <= {reach} OR _r > 1 OR (_r > 0 AND _e > 0)")
    near = per_sec.select("_i", "_kv", "_date", "_sec", "_r", F.sum("_r").over(w).alias("_rs"), F.sum("_e").over(w).alias("_es"))
    near = cut_lineage(near.where("_r > 0 AND (_rs > 1 OR _es > 0)").select("_i", "_kv", "_date", "_sec", (F.col("_es") > 0).alias("_busy")))
    out = req
    for i, (_, key) in enumerate(_KEY_TYPES):
        met = near.where(F.col("_i") == i).select(F.col("_kv").alias(key), "_date", "_sec", F.col("_busy").alias(f"_busy{i}"))
        out = out.join(met, [key, "_date", "_sec"], "left")
    alone = F.col("_busy0").isNull() & F.col("_busy1").isNull()
    flags = {f"_busy{i}": F.coalesce(f"_busy{i}", F.lit(False)) for i in (0, 1)}
    return cut_lineage(out.withColumn("_alone", alone).withColumns(flags))


def _day_pass(minutes: int):
    """A pass over sorted rows (key, _date, _sec, _m, _sure) that starts anew at each key and date; see ``_round``.

    It keeps the accepted and the open seconds of one day (at most 86,400), whatever batches the rows come in.
    """
    reach = minutes * 60 - 1

    def close(seconds: list[int], sec: int) -> bool:
        at = bisect_left(seconds, sec - reach)
        return at < len(seconds) and seconds[at] <= sec + reach

    def run(batches):
        day, taken, open_ = None, [], []
        for batch in batches:
            verdict = []
            for key, date, sec, sure in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (key, date) != day:
                    day, taken, open_ = (key, date), [], []
                if close(taken, sec):
                    verdict.append("rejected")
                elif sure and not close(open_, sec):
                    verdict.append("accepted")
                    insort(taken, sec)
                else:
                    verdict.append("open")
                    insort(open_, sec)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string())], names=["key", "_date", "_sec", "_m", "_v"])

    return run


def _pass_days(days: DataFrame, key: str, minutes: int, parts: int) -> DataFrame:
    """The verdict per (key, _date, _sec) of ``days`` (with _m, _sure): days are dealt to ``parts`` tasks by their
    number, not by bytes, and each task passes its days one after the other, not as one group each."""
    order = days.select(key, "_date", "_sec", "_m", "_sure").repartition(parts, key, "_date").sortWithinPartitions(key, "_date", "_m")
    return order.mapInArrow(_day_pass(minutes), "key string, _date date, _sec int, _m bigint, _v string").withColumnRenamed("key", key)


def _round(pending: DataFrame, blocking: DataFrame | None, minutes: int) -> DataFrame:
    """One acceptance round over the pending requests (no ``blocking``: none has an accepted one in reach); adds ``_state``.

    1. A pending request with an existing or accepted appointment in reach is rejected.
    2. Of the rest, a request is *alone* on a key if no other is in its window there, and *first* if no
       earlier one is in its window on either key (so it is accepted).
    3. Per key and date, requests are passed in ``seq`` order (the smallest of each second; the others of
       that second cannot do better). One in reach of an accepted one is rejected; else, if it is first or
       alone on the other key, and out of reach of open ones, it is accepted; else it is open.
    4. What is open with a single earlier neighbour follows from that one; see ``_settle_chains``.
    """
    if blocking is None:
        return _decide(pending, minutes)
    out = pending
    for i, (kt, key) in enumerate(_KEY_TYPES):
        pts = pending.select(key, "_date", "_sec")
        near = _near(pts, blocking, kt, key, minutes, [F.sum("_acc").alias("_acc")],
                     [(F.sum, "_acc", f"_block{i}")])
        out = out.join(near, [key, "_date", "_sec"])
    out = out.withColumn("_blocked", F.coalesce(F.col("_block0") > 0, F.lit(False))
                         | F.coalesce(F.col("_block1") > 0, F.lit(False))).drop("_block0", "_block1")
    out = cut_lineage(out)
    decided = _decide(out.where(~F.col("_blocked")).drop("_blocked"), minutes)
    return decided.unionByName(out.where("_blocked").select(*pending.columns, F.lit("rejected").alias("_state")))


def _decide(alive: DataFrame, minutes: int) -> DataFrame:
    """Steps 2 to 4 of a round."""
    seen = alive
    for i, (_, key) in enumerate(_KEY_TYPES):
        per_sec = alive.groupBy(key, "_date", "_sec").agg(F.min("seq").alias("_m"), F.max("seq").alias("_l"), F.count(F.lit(1)).alias("_c"))
        w = _window(key, minutes)
        near = per_sec.select(key, "_date", "_sec", F.min("_m").over(w).alias(f"_wait{i}"), F.max("_l").over(w).alias(f"_last{i}"),
                              F.sum("_c").over(w).alias(f"_n{i}"))
        seen = seen.join(near, [key, "_date", "_sec"])
    first = (F.col("_wait0") >= F.col("seq")) & (F.col("_wait1") >= F.col("seq"))
    # The only earlier neighbour, where the counts tell that there is just one.
    none = [F.col(f"_wait{i}") >= F.col("seq") for i in (0, 1)]
    one = [~none[i] & ((F.col(f"_n{i}") == 2) | ((F.col(f"_n{i}") == 3) & (F.col(f"_last{i}") > F.col("seq")))) for i in (0, 1)]
    prev = (F.when(one[0] & (none[1] | (one[1] & (F.col("_wait0") == F.col("_wait1")))), F.col("_wait0"))
            .when(none[0] & one[1], F.col("_wait1")))
    seen = cut_lineage(seen.withColumn("_first", first).withColumn("_prev", prev).drop("_wait0", "_wait1", "_last0", "_last1"))
    parts = seen.count() // ROWS_PER_PASS + 1
    state = seen
    for i, (_, key) in enumerate(_KEY_TYPES):
        sure = F.col("_first") | (F.col(f"_n{1 - i}") == 1)
        days = seen.where(F.col(f"_n{i}") > 1).groupBy(key, "_date", "_sec").agg(F.min(F.struct("seq", sure.alias("s"))).alias("_l"))
        days = days.select(key, "_date", "_sec", F.col("_l.seq").alias("_m"), F.col("_l.s").alias("_sure"))
        passed = _pass_days(days, key, minutes, parts)
        state = state.join(passed.withColumnsRenamed({"_m": f"_m{i}", "_v": f"_v{i}"}), [key, "_date", "_sec"], "left")
    lost = [(F.col(f"_v{i}") == "rejected") | ((F.col(f"_v{i}") == "accepted") & (F.col(f"_m{i}") < F.col("seq"))) for i in (0, 1)]
    won = [(F.col(f"_n{1 - i}") == 1) & ((F.col(f"_n{i}") == 1) | (F.col(f"_v{i}") == "accepted")) for i in (0, 1)]
    no = F.lit(False)
    verdict = (F.when(F.coalesce(lost[0], no) | F.coalesce(lost[1], no), "rejected")
               .when(F.col("_first") | F.coalesce(won[0], no) | F.coalesce(won[1], no), "accepted").otherwise("pending"))
    decided = cut_lineage(state.select(*alive.columns, verdict.alias("_state"), "_prev"))
    return _settle_chains(decided).drop("_prev")


def _settle_chains(state: DataFrame) -> DataFrame:
    """Decide pending requests that hang on a decided one by a chain of single earlier neighbours (``_prev``).

    Such a request is accepted iff its neighbour is not. Each step doubles the jump of every
    request; ``_odd`` tells whether the outcome turns an odd number of times on the way.
    """
    links = state.where((F.col("_state") == "pending") & F.col("_prev").isNotNull())
    links = links.select("seq", F.col("_prev").alias("_at"), F.lit(True).alias("_odd"))
    if links.isEmpty():
        return state
    while True:
        on = links.select(F.col("seq").alias("_at"), F.col("_at").alias("_far"), F.col("_odd").alias("_turn"))
        links = cut_lineage(links.join(on, "_at", "left").select(
            "seq", F.coalesce("_far", "_at").alias("_at"), (F.col("_odd") != F.coalesce("_turn", F.lit(False))).alias("_odd"),
            F.col("_far").isNotNull().alias("_moved")))
        if links.where("_moved").isEmpty():
            break
    ends = state.where(F.col("_state") != "pending").select(F.col("seq").alias("_at"), (F.col("_state") == "accepted").alias("_end"))
    told = links.join(ends, "_at").select("seq", F.when(F.col("_end") == F.col("_odd"), "rejected").otherwise("accepted").alias("_told"))
    settled = state.join(told, "seq", "left").withColumn("_state", F.coalesce("_told", "_state")).drop("_told")
    return cut_lineage(settled.select(*state.columns))


def _earlier_conflict(req: DataFrame, blocking: DataFrame, minutes: int) -> DataFrame:
    """Flags ``_conf_p`` / ``_conf_d``: an existing or accepted appointment with a smaller
    seq lies in the window on that key (the sequential rule)."""
    out = req
    for (kt, key), name in zip(_KEY_TYPES, ("_conf_p", "_conf_d")):
        pts = req.select(key, "_date", "_sec")
        near = _near(pts, blocking, kt, key, minutes, [F.min("_aseq").alias("_amin")],
                     [(F.min, "_amin", f"_nb{name}")])
        out = out.join(near, [key, "_date", "_sec"])
        out = out.withColumn(name, F.coalesce(F.col(f"_nb{name}") < F.col("seq"), F.lit(False))).drop(f"_nb{name}")
    return out


def book_appointments(appts: DataFrame, bills: DataFrame, patients: DataFrame, doctors: DataFrame,
                      requests: DataFrame, as_of=None, distinct_codes: bool = False, minutes: int = 30,
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decide an ordered batch of booking calls; returns (appointments, bills, outcome)
    with the booked rows appended (see ``book_new_rows``)."""
    new_appts, new_bills, outcome = book_new_rows(appts, bills, patients, doctors, requests, as_of=as_of,
                                                  distinct_codes=distinct_codes, minutes=minutes)
    return _append(appts, new_appts), _append(bills, new_bills), outcome


def book_new_rows(appts: DataFrame, bills: DataFrame, patients: DataFrame, doctors: DataFrame,
                  requests: DataFrame, as_of=None, distinct_codes: bool = False, minutes: int = 30,
                  tops: tuple[int, int] | None = None, rounds: list[int] | None = None, held: bool = False,
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decide an ordered batch of booking calls.

    ``requests``: seq, Patient_ID, Doctor_ID, Appointment_Date, Appointment_Time,
    Department (text as typed). ``as_of`` is "today" for the past-date rule
    (None: no such rule). Returns (new appointment rows, new bill rows, outcome); outcome
    ``status`` is 0 booked, -1 slot taken (``distinct_codes``: -2 when the
    doctor, not the patient, is busy), NULL for a failed insert or an
    invalid request; ``reason`` and ``message`` explain. ``tops`` gives the largest
    appointment and bill id numbers where the caller keeps them (else they are
    read off the tables); ``rounds`` takes the number of rounds; ``held`` tells that the requests
    are a table stored by ``checked_calls``, of unique ``seq``.
    """
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    valid, invalid = _valid_and_invalid(requests, held)
    # Why a call fails once its slot is free; NULL where it would not.
    why = F.lit(None).cast("string") if as_of is None else F.when(F.col("_date") < F.lit(str(as_of)).cast("date"), "past_date")
    req = valid.withColumn("_why", why)
    missing = _keys_missing({"Patient_ID": patients, "Doctor_ID": doctors}, valid)
    for key, reason in (("Patient_ID", "unknown_patient"), ("Doctor_ID", "unknown_doctor")):
        gone = missing.where(F.col("_key") == key).select(F.col("_v").alias(key), F.lit(reason).alias("_gone"))
        req = req.join(gone, key, "left").withColumn("_why", F.coalesce("_why", "_gone")).drop("_gone")
    sifted = _sift(valid, req, _existing(appts, valid), minutes)
    contested = sifted.where(~F.col("_alone"))

    # Rounds over what has others in reach and no existing appointment. Pending requests only decrease, so
    # after each round the blocking rows are cut down to the key-dates that still have pending requests.
    pending = contested.where("_why IS NULL AND NOT _busy0 AND NOT _busy1").select("seq", "Patient_ID", "Doctor_ID", "_date", "_sec")
    blocking = None
    accepted_parts: list[DataFrame] = []
    while True:
        decided = _round(pending, blocking, minutes)
        newly = decided.where(F.col("_state") == "accepted").select("seq", "Patient_ID", "Doctor_ID", "_date", "_sec")
        accepted_parts.append(newly)
        pending = decided.where(F.col("_state") == "pending").select("seq", "Patient_ID", "Doctor_ID", "_date", "_sec")
        if pending.isEmpty():
            if rounds is not None:
                rounds.append(len(accepted_parts))
            break
        grown = _by_key(newly, F.lit(1), F.col("seq"))
        grown = grown if blocking is None else blocking.unionByName(grown)
        blocking = cut_lineage(grown.join(_live(pending), ["_kt", "_kv", "_date"], "left_semi"))

    # Accepted requests have no earlier conflict by construction. For the rest,
    # status and reason follow the sequential rule against the existing and the accepted set.
    all_accepted = _union(accepted_parts)
    fields = ["seq", "Patient_ID", "Doctor_ID", "_date", "_sec", "Department"]
    accepted = sifted.where("_alone AND _why IS NULL").select(*fields).unionByName(
        contested.select(*fields).join(all_accepted.select("seq"), "seq", "left_semi"))
    rest = contested.join(all_accepted.select("seq"), "seq", "left_anti")
    # An existing appointment of the patient is the reason whatever else there is; the others meet the accepted ones.
    met = _earlier_conflict(rest.where("NOT _busy0"), _by_key(all_accepted, F.lit(1), F.col("seq")), minutes)
    met = met.withColumn("_conf_d", F.col("_conf_d") | F.col("_busy1"))
    known = rest.where("_busy0").unionByName(sifted.where("_alone AND _why IS NOT NULL"))
    rest = met.unionByName(known.withColumns({"_conf_p": F.col("_busy0"), "_conf_d": F.lit(False)}))
    doctor_code = -2 if distinct_codes else -1
    status = F.when(F.col("_conf_p"), F.lit(-1)).when(F.col("_conf_d"), F.lit(doctor_code)).cast("int")
    reason = F.when(F.col("_conf_p"), "patient").when(F.col("_conf_d"), "doctor").otherwise(F.col("_why"))
    rest = rest.select(*fields, status.alias("status"), reason.alias("reason"))

    booked = global_rank(accepted, ["seq"], "_rank").withColumns({"status": F.lit(0), "reason": F.lit(None).cast("string")})
    top_a, top_b = (F.lit(t) for t in tops) if tops else (
        top_id_number(appts, "Appointment_ID", "A"), top_id_number(bills, "Bill_ID", "B"))
    booked = (booked.withColumn("Appointment_ID", format_id("A", top_a + F.col("_rank")))
              .withColumn("Bill_ID", format_id("B", top_b + F.col("_rank"))))

    time = sec_to_time("_sec").alias("Appointment_Time")
    new_appts = booked.select(
        "Appointment_ID", "Patient_ID", "Doctor_ID", "Department", F.col("_date").alias("Appointment_Date"),
        time, F.lit("Scheduled").alias("Status"), F.lit(1).alias("version"))
    new_bills = booked.select(
        "Bill_ID", "Patient_ID", F.concat(F.col("Department"), F.lit(" Consultation")).alias("Service_Type"),
        F.col("_date").alias("Service_Date"), F.lit(200).cast("decimal(10,2)").alias("Amount_Charged"),
        F.lit(0).cast("decimal(10,2)").alias("Amount_Paid"), F.lit(None).cast("date").alias("Payment_Date"),
        F.lit("Pending").alias("Payment_Status"), F.lit(1).alias("version"))

    no_id = F.lit(None).cast("string")
    rest_rows = rest.withColumn("Appointment_ID", no_id).withColumn("Bill_ID", no_id)
    decided_rows = booked.select(*rest_rows.columns).unionByName(rest_rows)
    message = (F.when(F.col("status") == 0, F.concat(F.lit(MSG_BOOKED), F.col("Appointment_ID")))
               .when(F.col("status") < 0, F.lit(MSG_SLOT_TAKEN))
               .when(F.col("reason") == "past_date", F.lit(PAST_APPOINTMENT_MESSAGE))
               .otherwise(F.lit(MSG_MISSING_PARENT)))
    outcome = decided_rows.select(
        "seq", "Patient_ID", "Doctor_ID", F.col("_date").alias("Appointment_Date"), time,
        "status", "reason", message.alias("message"), "Appointment_ID", "Bill_ID")
    rejected = invalid.select(
        "seq", "Patient_ID", "Doctor_ID", F.lit(None).cast("date").alias("Appointment_Date"),
        F.col("Appointment_Time"), F.lit(None).cast("int").alias("status"),
        F.lit("invalid_request").alias("reason"), F.col("error").alias("message"),
        F.lit(None).cast("string").alias("Appointment_ID"), F.lit(None).cast("string").alias("Bill_ID"))
    return new_appts, new_bills, outcome.unionByName(rejected)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _append(table: DataFrame, rows: DataFrame) -> DataFrame:
    cols = [c for c in table.columns if c in rows.columns]
    extra = [c for c in rows.columns if c not in table.columns]
    # Rows from before a column was there have its default: 1 for ``version``, NULL for any other.
    fill = [F.lit(1 if c == "version" else None).cast(rows.schema[c].dataType).alias(c) for c in extra]
    base = table.select("*", *fill)
    return base.unionByName(rows.select(*[F.col(c).cast(table.schema[c].dataType) for c in cols], *extra),
                            allowMissingColumns=True)
