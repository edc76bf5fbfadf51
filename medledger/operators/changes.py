"""Ordered batch changes: each stored routine or client update becomes a pure
function from DataFrames to (new snapshot, outcome per request).

Requests carry ``seq``: the order in which the calls would have run. Every
"last one wins" rule is an aggregate (``max_by`` on seq), and every running
balance uses ``running_sums``, a fold of a bounded array or chains followed by doubling, so a
bill or appointment with a huge share of the requests is never collected into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medledger.operators.ordering import order_bits, ordered_requests, running_sums
from medledger.operators.quality import NEGATIVE_BILLING_MESSAGE, Rule, enforce, validate_requests
from medledger.session import cut_lineage

# Outcome texts of the routines and the console client.
MSG_PAYMENT_OK = "Payment processed successfully"
MSG_PAYMENT_FAILED = "Payment failed - record was modified by another transaction"
MSG_COMPLETED = "Appointment marked as completed"
MSG_CANCELED = "Appointment canceled"
MSG_APPOINTMENT_NOT_FOUND = "Appointment not found"
MSG_LAB_OK = "Lab result updated successfully"
MSG_LAB_NONE = "No records updated - check Lab Order ID"
MSG_LAB_TOO_LONG = "Data too long for column 'Result'"
MSG_BAD_ACTION = "Unknown action"
MSG_OUT_OF_RANGE = "Out of range value for column 'Amount_Paid'"


# Largest amount that DECIMAL(10,2) holds, in cents.
MAX_CENTS = 10**10 - 1
#: Payments of one bill that are folded as one array; those behind them are decided by chains.
FOLD_ROWS = 128
#: Payments of one plain bill that are summed in one window; where a bill has more, ``running_sums`` cuts them up.
WINDOW_ROWS = 1 << 20


def apply_payments(bills: DataFrame, payments: DataFrame, use_version: bool | None = None, held: bool = False,
                   ) -> tuple[DataFrame, DataFrame]:
    """Apply payments per bill in ``seq`` order; returns (bills, outcome).

    Each accepted payment adds its amount; the status becomes Paid once the
    new paid amount reaches the charge, else Pending (one evaluation, see
    README). As in the routine, ``version`` is bumped by every accepted payment
    if the bills have that column (``use_version`` overrides). A payment may
    carry ``expected_version``: it fails when the bill has moved on by its turn.

    Refused payments leave the bill as it is, with a reason: ``invalid_request``
    (amount must be a positive number), ``not_found``, ``version_conflict``,
    ``negative_amount`` (the update rule: charge or new paid amount below zero)
    and ``out_of_range`` (the paid amount would not fit DECIMAL(10,2)).

    Most bills have no payment whose fate depends on another's: their totals are
    one aggregate, and running sums give the outcomes. Bills where it does
    (an expected version, a negative paid amount, a sum out of range) are decided in
    order: the first ``FOLD_ROWS`` payments of a bill by folding an array, any others
    by chains over all bills (see ``_chains``), so no task holds more of one bill.
    ``held`` tells that the payments are a stored table of unique ``seq``.
    """
    has_version = "version" in bills.columns
    use_version = has_version if use_version is None else use_version
    payments = payments if held else ordered_requests(payments, "payments")
    bits = order_bits(payments, "seq")
    if "expected_version" not in payments.columns:
        payments = payments.withColumn("expected_version", F.lit(None).cast("int"))
    valid, invalid = validate_requests(payments, "payment")
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    base = F.col("version") if has_version else F.lit(1)
    state = bills.select("Bill_ID", cents("Amount_Charged").alias("_charged"), cents("Amount_Paid").alias("_paid"),
                         base.cast("bigint").alias("_version"), F.lit(True).alias("_found"))
    asked = valid.groupBy("Bill_ID").agg(
        F.sum(cents("amount")).alias("_add"), F.count(F.lit(1)).alias("_k"),
        F.max(F.col("expected_version").isNotNull()).alias("_guarded"))
    asked = asked.join(state, "Bill_ID", "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    walk = F.col("_guarded") | (F.col("_paid") < 0) | (F.col("_paid") + F.col("_add") > MAX_CENTS)
    # One row per bill that is paid on: how its payments are decided.
    asked = asked.withColumn("_way", F.when(~F.col("_found"), "not_found").when(F.col("_charged") < 0, "negative_amount")
                             .when(walk, "walk").otherwise("plain"))
    asked = cut_lineage(asked)
    ways = asked.drop("_add", "_guarded", "_found")
    j = valid.where(F.col("Bill_ID").isNotNull()).join(ways, "Bill_ID")

    walk_rows = j.where("_way = 'walk'").drop("_k")
    walked = payments.sparkSession.createDataFrame([], _WALKED) if asked.where("_way = 'walk'").isEmpty() else _walk(walk_rows, bits)
    plain = j.where("_way = 'plain'").withColumn("_cents", cents("amount")).withColumn("_one", F.lit(1))
    # The window has the partitions of the join; only bills with a crowd of payments are cut up and joined again.
    w = Window.partitionBy("Bill_ID").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = plain.where(F.col("_k") <= WINDOW_ROWS).withColumns({"_sum": F.sum("_cents").over(w), "_n": F.sum("_one").over(w)})
    if asked.where((F.col("_way") == "plain") & (F.col("_k") > WINDOW_ROWS)).isEmpty():
        plain = few
    else:
        many = plain.where(F.col("_k") > WINDOW_ROWS)
        plain = few.unionByName(running_sums(many, ["Bill_ID"], "seq", {"_sum": "_cents", "_n": "_one"}, order_bits=bits))
    money = lambda c: (c.cast("decimal(20,0)") / 100).cast("decimal(10,2)")

    def rows(df: DataFrame, amount: Column, reason: Column, paid: Column, version: Column) -> DataFrame:
        ok = reason.isNull()
        bad = (F.when(reason == "negative_amount", NEGATIVE_BILLING_MESSAGE).when(reason == "out_of_range", MSG_OUT_OF_RANGE)
               .otherwise(MSG_PAYMENT_FAILED))
        return df.select(
            "seq", "Bill_ID", amount.alias("amount"), ok.alias("ok"), F.when(ok, money(paid)).alias("Amount_Paid"),
            F.when(ok, F.when(paid >= F.col("_charged"), "Paid").otherwise("Pending")).alias("Payment_Status"),
            F.when(ok & F.lit(use_version), version.cast("int")).alias("version"),
            reason.alias("reason"), F.when(ok, MSG_PAYMENT_OK).otherwise(bad).alias("message"))

    none = F.lit(None).cast("string")
    nobody = valid.where(F.col("Bill_ID").isNull()).withColumn("_way", F.lit("not_found"))  # a call may lack its bill
    refused = j.where("_way IN ('not_found', 'negative_amount')").unionByName(nobody, allowMissingColumns=True)
    outcome = rows(plain, F.col("amount"), none, F.col("_paid") + F.col("_sum"), F.col("_version") + F.col("_n"))
    moved = (F.col("_way") == "negative_amount") & (F.col("expected_version") != F.col("_version"))
    why = F.when(F.coalesce(moved, F.lit(False)), "version_conflict").otherwise(F.col("_way"))
    outcome = outcome.unionByName(rows(refused, F.col("amount"), why, F.lit(0).cast("bigint"), F.lit(0)))
    charges = asked.where("_way = 'walk'").select("Bill_ID", "_charged")
    outcome = outcome.unionByName(rows(walked.join(charges, "Bill_ID"), money(F.col("cents")), F.col("reason"),
                                       F.col("paid"), F.col("version")))
    null = lambda t: F.lit(None).cast(t)
    outcome = outcome.unionByName(invalid.select(
        "seq", "Bill_ID", null("decimal(10,2)").alias("amount"), F.lit(False).alias("ok"),
        null("decimal(10,2)").alias("Amount_Paid"), null("string").alias("Payment_Status"), null("int").alias("version"),
        F.lit("invalid_request").alias("reason"), F.col("error").alias("message")))

    done = asked.where("_way = 'plain'").select("Bill_ID", (F.col("_paid") + F.col("_add")).alias("_new"), "_k")
    last = walked.where("reason IS NULL").groupBy("Bill_ID").agg(F.max_by("paid", "seq").alias("_new"), F.count(F.lit(1)).alias("_k"))
    nb = bills.join(done.unionByName(last), "Bill_ID", "left")
    changed, new_paid = F.col("_new").isNotNull(), money(F.col("_new"))
    cols = {
        "Amount_Paid": F.when(changed, new_paid).otherwise(F.col("Amount_Paid")),
        "Payment_Status": F.when(changed, F.when(new_paid >= F.col("Amount_Charged"), "Paid").otherwise("Pending"))
        .otherwise(F.col("Payment_Status")),
    }
    if use_version:
        cols["version"] = (base + F.coalesce(F.col("_k"), F.lit(0))).cast("int")
    new_bills = nb.select(*[cols.get(c, F.col(c)).alias(c) for c in bills.columns],
                          *([cols["version"].alias("version")] if use_version and not has_version else []))
    return new_bills, outcome


_WALKED = "seq bigint, Bill_ID string, cents bigint, reason string, paid bigint, version bigint"


def _walk(j: DataFrame, bits: int) -> DataFrame:
    """Decide the payments of contested bills in order.

    Returns seq, Bill_ID, cents, reason (null: accepted), paid and version after each payment. The first
    ``FOLD_ROWS`` payments of a bill are one array, folded by an expression; where a bill has more,
    ``_chains`` decides the rest for all such bills at once.
    """
    rows = j.select("seq", "Bill_ID", (F.col("amount") * 100).cast("bigint").alias("cents"),
                    F.col("expected_version").cast("bigint").alias("expected"), F.col("_paid").alias("paid"),
                    F.col("_version").alias("version"), F.lit(1).alias("_one"))
    rows = cut_lineage(running_sums(rows, ["Bill_ID"], "seq", {"_nth": "_one"}, order_bits=bits).drop("_one"))
    head = rows.where(F.col("_nth") <= FOLD_ROWS).groupBy("Bill_ID", "paid", "version").agg(
        F.array_sort(F.collect_list(F.struct("seq", "cents", "expected"))).alias("_calls"))
    step = "struct<seq:bigint,cents:bigint,reason:string,paid:bigint,version:bigint>"
    start = F.struct(F.col("paid"), F.col("version"), F.array().cast(f"array<{step}>").alias("done"))

    def fold(state: Column, call: Column) -> Column:
        reason = _refusal(state["paid"], state["version"], call["cents"], call["expected"])
        paid = F.when(reason.isNull(), state["paid"] + call["cents"]).otherwise(state["paid"])
        version = F.when(reason.isNull(), state["version"] + 1).otherwise(state["version"])
        now = F.struct(call["seq"].alias("seq"), call["cents"].alias("cents"), reason.alias("reason"), paid.alias("paid"), version.alias("version"))
        return F.struct(paid.alias("paid"), version.alias("version"), F.concat(state["done"], F.array(now.cast(step))).alias("done"))

    head = head.select("Bill_ID", F.explode(F.aggregate("_calls", start, fold)["done"]).alias("_r"))
    head = cut_lineage(head.select("_r.seq", "Bill_ID", "_r.cents", "_r.reason", "_r.paid", "_r.version"))
    rest = rows.where(F.col("_nth") > FOLD_ROWS).drop("paid", "version", "_nth")
    if rest.isEmpty():
        return head
    state = head.groupBy("Bill_ID").agg(F.max_by("paid", "seq").alias("paid"), F.max_by("version", "seq").alias("version"))
    state = cut_lineage(state.join(rest.select("Bill_ID").distinct(), "Bill_ID", "left_semi"))
    accepted = _chains(rest, state, bits).withColumn("_ok", F.lit(1))
    rest = rest.join(accepted, ["Bill_ID", "seq"], "left").join(state, "Bill_ID")
    rest = rest.withColumn("_ok", F.coalesce("_ok", F.lit(0))).withColumn("_got", F.col("cents") * F.col("_ok"))
    rest = running_sums(rest, ["Bill_ID"], "seq", {"_sum": "_got", "_n": "_ok"}, order_bits=bits)
    paid, version = F.col("paid") + F.col("_sum"), F.col("version") + F.col("_n")
    reason = F.when(F.col("_ok") == 0, _refusal(paid, version, F.col("cents"), F.col("expected")))
    return head.unionByName(rest.select("seq", "Bill_ID", "cents", reason.alias("reason"), paid.alias("paid"), version.alias("version")))


def _refusal(paid: Column, version: Column, cents: Column, expected: Column) -> Column:
    """Why a bill in this state refuses a payment; null: it does not."""
    return (F.when(expected.isNotNull() & (expected != version), "version_conflict").when(paid + cents < 0, "negative_amount")
            .when(paid + cents > MAX_CENTS, "out_of_range"))


def _chains(rows: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    """The accepted payments (Bill_ID, seq) of bills in a given state (paid, version), whatever their number.

    A payment without an expected version moves the version by one. One that expects a version is accepted if the
    expected version, less the payments without one before it, is what the accepted ones before it have made of it. So
    the accepted ones of a bill are a chain: the first that is due at 0, the first behind that due at 1, and so on.
    ``_chain`` follows all bills' chains by doubling. Where a bill could run out of range, the chain holds up to the
    first payment that does not fit, and the next round goes on behind it, without those too large for what is left.
    """
    first = F.lit(-(1 << 63)).cast("bigint")
    opening = rows.join(state.where("paid < 0"), "Bill_ID").where(
        (F.col("paid") + F.col("cents") >= 0) & (F.col("expected").isNull() | (F.col("expected") == F.col("version"))))
    opening = opening.groupBy("Bill_ID").agg(F.min(F.struct("seq", "cents")).alias("_o"))  # the first that ends a debt
    opening = cut_lineage(opening.select("Bill_ID", "_o.seq", F.col("_o.cents").alias("_add")))
    accepted = [opening.select("Bill_ID", "seq")]
    state = state.join(opening, "Bill_ID", "left").where("paid >= 0 OR seq IS NOT NULL").select(
        "Bill_ID", (F.col("paid") + F.coalesce("_add", F.lit(0))).alias("paid"),
        (F.col("version") + F.when(F.col("seq").isNull(), 0).otherwise(1)).alias("version"), F.coalesce("seq", first).alias("_from"))
    while True:
        fit = rows.join(state, "Bill_ID").where((F.col("seq") > F.col("_from")) & (F.col("paid") + F.col("cents") <= MAX_CENTS))
        fit = fit.withColumn("_free", F.col("expected").isNull().cast("int")).withColumn("_one", F.lit(1))
        fit = cut_lineage(running_sums(fit, ["Bill_ID"], "seq", {"_u": "_free"}, order_bits=bits))
        due = fit.where("_free = 0").select("Bill_ID", "seq", (F.col("expected") - F.col("version") - F.col("_u")).alias("due"))
        chain = _chain(due.where("due >= 0"), bits).withColumn("_in", F.lit(True))
        taken = fit.join(chain, ["Bill_ID", "seq"], "left").where("_free = 1 OR _in")
        taken = cut_lineage(running_sums(taken.drop("_in"), ["Bill_ID"], "seq", {"_sum": "cents", "_n": "_one"}, order_bits=bits))
        over = taken.where(F.col("paid") + F.col("_sum") > MAX_CENTS)
        stops = cut_lineage(over.groupBy("Bill_ID").agg(F.min("seq").alias("_stop")))
        good = taken.join(stops, "Bill_ID", "left").where("_stop IS NULL OR seq < _stop")
        accepted.append(good.select("Bill_ID", "seq"))
        if stops.isEmpty():
            return reduce(DataFrame.unionByName, accepted)
        moved = good.where("_stop IS NOT NULL").groupBy("Bill_ID").agg(F.max("_sum").alias("_add"), F.max("_n").alias("_k"))
        state = cut_lineage(state.join(stops, "Bill_ID").join(moved, "Bill_ID", "left").select(
            "Bill_ID", (F.col("paid") + F.coalesce("_add", F.lit(0))).alias("paid"),
            (F.col("version") + F.coalesce("_k", F.lit(0))).alias("version"), F.col("_stop").alias("_from")))


def _chain(due: DataFrame, bits: int) -> DataFrame:
    """Per bill, the first row due at 0, the first behind it due at 1, and so on (Bill_ID, seq), in log2(length) rounds.

    A row's successor is the row due at one more whose rank is one above the number of such rows before it; ranks
    and numbers are running sums, so no crowd of rows that are due at one time meets in one window.
    """
    seen = due.withColumn("_is", F.lit(1)).unionByName(due.withColumn("due", F.col("due") + 1).withColumn("_is", F.lit(0)))
    seen = cut_lineage(running_sums(seen, ["Bill_ID", "due"], "seq", {"_r": "_is"}, order_bits=bits))
    there = seen.where("_is = 1").select("Bill_ID", "due", "_r", F.col("seq").alias("_next"))
    jump = cut_lineage(seen.where("_is = 0").withColumn("_r", F.col("_r") + 1).join(there, ["Bill_ID", "due", "_r"]).select("Bill_ID", "seq", "_next"))
    parts = [seen.where("_is = 1 AND due = 0 AND _r = 1").select("Bill_ID", "seq")]
    while True:
        found = reduce(DataFrame.unionByName, parts)
        more = cut_lineage(found.join(jump, ["Bill_ID", "seq"]).select("Bill_ID", F.col("_next").alias("seq")))
        if more.isEmpty():
            return found
        parts.append(more)
        # Jumps twice as far, for the bills whose chain goes on.
        on = jump.join(more.select("Bill_ID").distinct(), "Bill_ID", "left_semi")
        far = on.select("Bill_ID", F.col("seq").alias("_next"), F.col("_next").alias("_far"))
        jump = cut_lineage(on.join(far, ["Bill_ID", "_next"]).select("Bill_ID", "seq", F.col("_far").alias("_next")))


def apply_status_changes(appts: DataFrame, bills: DataFrame, changes: DataFrame
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Complete or cancel appointments in ``seq`` order.

    complete: appointment Completed, the patient's bills of that date
    Processing. cancel: Canceled and Void. The last change wins, per
    appointment and per (patient, date) for bills. Unknown ids change
    nothing and are reported ``not_found``. The update rule of the bills holds:
    a change that would touch a bill with a negative amount fails as a whole
    (``negative_amount``). Returns (appts, bills, outcome).
    """
    changes = ordered_requests(changes, "status changes")
    act = F.lower(F.trim(F.col("action")))
    c = changes.select("seq", "Appointment_ID", "action", act.alias("_act"))
    keys = appts.select("Appointment_ID", "Patient_ID", F.col("Appointment_Date").alias("_date"),
                        F.lit(True).alias("_found"))
    j = c.join(keys, "Appointment_ID", "left")
    good = F.col("_act").isin("complete", "cancel")
    found = F.coalesce(F.col("_found"), F.lit(False))
    # The amounts do not change here, so a (patient, date) is refused for every change or for none.
    barred = bills.where((F.col("Amount_Charged") < 0) | (F.col("Amount_Paid") < 0)).select(
        F.col("Patient_ID").alias("_bp"), F.col("Service_Date").alias("_bd"), F.lit(True).alias("_barred")).distinct()
    j = j.join(barred, (F.col("Patient_ID") == F.col("_bp")) & (F.col("_date") == F.col("_bd")), "left")
    free = F.col("_barred").isNull()
    applied = j.where(good & found & free)

    per_appt = applied.groupBy("Appointment_ID").agg(F.max_by("_act", "seq").alias("_last"))
    per_day = applied.groupBy(F.col("Patient_ID").alias("_pid"), F.col("_date").alias("_sdate")).agg(
        F.max_by("_act", "seq").alias("_last_bill"))

    new_status = (F.when(F.col("_last") == "complete", "Completed").when(F.col("_last") == "cancel", "Canceled")
                  .otherwise(F.col("Status")))
    na = appts.join(per_appt, "Appointment_ID", "left")
    new_appts = na.select(*[(new_status if col == "Status" else F.col(col)).alias(col) for col in appts.columns])

    nb = bills.join(per_day, (bills.Patient_ID == per_day._pid) & (bills.Service_Date == per_day._sdate), "left")
    bill_status = (F.when(F.col("_last_bill") == "complete", "Processing")
                   .when(F.col("_last_bill") == "cancel", "Void").otherwise(F.col("Payment_Status")))
    new_bills = nb.select(*[(bill_status if col == "Payment_Status" else bills[col]).alias(col)
                            for col in bills.columns])

    outcome = j.select(
        "seq", "Appointment_ID", "action", F.coalesce(good & found & free, F.lit(False)).alias("ok"),
        F.when(~F.coalesce(good, F.lit(False)), "invalid_request").when(~found, "not_found")
        .when(~free, "negative_amount").alias("reason"),
        F.when(~F.coalesce(good, F.lit(False)), MSG_BAD_ACTION).when(~found, MSG_APPOINTMENT_NOT_FOUND)
        .when(~free, NEGATIVE_BILLING_MESSAGE)
        .when(F.col("_act") == "complete", MSG_COMPLETED).otherwise(MSG_CANCELED).alias("message"))
    return new_appts, new_bills, outcome


def update_lab_results(labs: DataFrame, updates: DataFrame, max_length: int = 20) -> tuple[DataFrame, DataFrame]:
    """Set ``Result`` by ``Lab_Order_ID``; the last update in ``seq`` order wins.

    Unknown ids are reported "No records updated"; results longer than the
    column are rejected. Returns (labs, outcome).
    """
    valid, invalid = validate_requests(ordered_requests(updates, "lab updates"), "lab_update")
    ids = labs.select("Lab_Order_ID").distinct().withColumn("_found", F.lit(True))
    j = valid.join(ids, "Lab_Order_ID", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    fits = F.length("Result") <= max_length
    last = (j.where(found & fits).groupBy("Lab_Order_ID")
            .agg(F.max_by("Result", "seq").alias("_new")))
    nl = labs.join(last, "Lab_Order_ID", "left")
    new_labs = nl.select(*[(F.coalesce(F.col("_new"), F.col("Result")) if c == "Result" else F.col(c)).alias(c)
                           for c in labs.columns])
    outcome = j.select(
        "seq", "Lab_Order_ID", "Result", (found & fits).alias("ok"),
        F.when(~found, "not_found").when(~fits, "too_long").alias("reason"),
        F.when(~found, MSG_LAB_NONE).when(~fits, MSG_LAB_TOO_LONG).otherwise(MSG_LAB_OK).alias("message"),
    ).unionByName(invalid.select("seq", "Lab_Order_ID", "Result", F.lit(False).alias("ok"),
                                 F.lit("invalid_request").alias("reason"), F.col("error").alias("message")))
    return new_labs, outcome


def update_where(df: DataFrame, cond: Column, sets: Mapping[str, Column | object],
                 rules: Sequence[Rule] = ()) -> DataFrame:
    """UPDATE ... SET col = value WHERE cond (a NULL condition leaves the row as it is).

    Every value is computed from the row before the update, as in SQL. ``rules``
    (``billing_rules()`` for bills) are held against every updated row after the
    update, like an update trigger: the first violation fails the whole statement.
    """
    hit = F.coalesce(cond, F.lit(False))
    out = []
    for c in df.columns:
        if c in sets:
            v = sets[c] if isinstance(sets[c], Column) else F.lit(sets[c])
            out.append(F.when(hit, v.cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    if not rules:
        return df.select(*out)
    updated = df.select(*out, hit.alias("_hit"))
    held = [Rule(r.name, F.col("_hit") & r.violation, r.message) for r in rules]
    return enforce(updated, held).drop("_hit")


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """DELETE WHERE cond: rows where it is false or NULL stay."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def affected_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Rows an UPDATE or DELETE with ``cond`` touches, as a one-row DataFrame."""
    return df.agg(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")).alias("affected_rows")).select(
        F.coalesce(F.col("affected_rows"), F.lit(0)).cast("bigint").alias("affected_rows"))
