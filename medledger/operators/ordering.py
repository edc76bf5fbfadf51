"""Order-dependent building blocks that stay parallel under skew.

* ``global_rank`` - dense 1..n positions in a total order without a
  single-partition window: range-partitioned sort, per-partition counts,
  prefix offsets over a table with one row per partition.
* ``running_sums`` - per-key running totals where one key may hold a third
  of all rows: the order axis is always cut into chunks of ``2**bits`` values,
  each chunk is summed locally, and chunk offsets come from the same
  procedure one level up (so no window partition exceeds ``2**bits`` rows).
* ``ordered_requests`` - materialises a batch and insists on unique ``seq``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medledger.session import cut_lineage

_PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition index above bit 33


def global_rank(df: DataFrame, order_cols: Sequence[str | Column], name: str = "rank",
                keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order ``order_cols``.

    Ties get distinct consecutive positions in an arbitrary but fixed order.
    The sorted, id-tagged rows are checkpointed so the ids cannot change if
    a task is recomputed after an executor loss. Of the columns, ``keep`` (or all) are kept.
    """
    tagged = cut_lineage(df.orderBy(*order_cols).select(*(keep or df.columns), F.monotonically_increasing_id().alias("_mid")))
    pid = F.shiftright(F.col("_mid"), _PARTITION_BITS)
    # One count per partition of ``tagged``: bounded by the partition count, so it
    # may come to the driver and go back as a small local table.
    counts = sorted(tuple(r) for r in tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1))).collect())
    offsets, running = [], 0
    for p, n in counts:
        offsets.append((p, running))
        running += n
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    out = tagged.withColumn("_pid", pid).join(F.broadcast(off), "_pid")
    return out.withColumn(name, (F.col("_off") + local + 1).cast("bigint")).drop("_pid", "_off", "_mid")


def ordered_requests(requests: DataFrame, what: str) -> DataFrame:
    """The batch, materialised once; its ``seq`` must be a total order (the calls ran one after the other)."""
    held = cut_lineage(requests)
    if not unique_seq(held):
        raise ValueError(f"{what} need unique seq values")
    return held


def unique_seq(held: DataFrame) -> bool:
    """Whether ``seq`` is never null and never repeated."""
    return held.groupBy("seq").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR seq IS NULL").isEmpty()


def order_bits(df: DataFrame, order_col: str) -> int:
    """The bits of the order axis that ``running_sums`` has to cover (one cheap aggregate; 64 if values are negative)."""
    low, high = df.agg(F.min(order_col), F.max(order_col)).first()
    return 64 if (low or 0) < 0 else max(1, int(high or 0).bit_length())


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    sums: Mapping[str, str],
    bits: int = 22,
    order_bits: int = 64,
) -> DataFrame:
    """Add inclusive running sums ``{out: value_col}`` per ``keys`` in ``order_col`` order.

    ``order_col`` must be integral and unique within a key. Null keys are a group like any other.
    The plan is the same whatever the data: by default it covers all 64 bits of the order axis; values
    known to be within ``[0, 2**order_bits)`` need fewer levels.
    """
    return _running(df, list(keys), order_col, dict(sums), bits, order_bits, 0)


def _running(df: DataFrame, keys: list[str], ocol: str, sums: dict[str, str], bits: int, span: int,
             level: int) -> DataFrame:
    upto_here = (Window.unboundedPreceding, Window.currentRow)
    if span <= bits:
        w = Window.partitionBy(*keys).orderBy(ocol).rowsBetween(*upto_here)
        return df.select("*", *[F.sum(v).over(w).alias(o) for o, v in sums.items()])
    chunk = f"_chunk{level}"
    d = df.withColumn(chunk, F.shiftright(F.col(ocol), bits))
    w = Window.partitionBy(*keys, chunk).orderBy(ocol).rowsBetween(*upto_here)
    loc = {o: f"_loc{level}_{o}" for o in sums}
    tot = {o: f"_tot{level}_{o}" for o in sums}
    inc = {o: f"_inc{level}_{o}" for o in sums}
    local = d.select("*", *[F.sum(v).over(w).alias(loc[o]) for o, v in sums.items()])
    totals = local.groupBy(*keys, chunk).agg(*[F.sum(v).alias(tot[o]) for o, v in sums.items()])
    prefix = _running(totals, keys, chunk, {inc[o]: tot[o] for o in sums}, bits, span - bits, level + 1)
    offsets = prefix.select(*keys, chunk, *[(F.col(inc[o]) - F.col(tot[o])).alias(f"_off{level}_{o}")
                                            for o in sums])
    right = offsets.toDF(*[f"_key{level}_{c}" for c in (*keys, chunk)], *offsets.columns[len(keys) + 1:])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key{level}_{c}")) for c in (*keys, chunk)])
    joined = local.join(right, same)
    return joined.select(
        *df.columns, *[(F.col(loc[o]) + F.col(f"_off{level}_{o}")).alias(o) for o in sums])
