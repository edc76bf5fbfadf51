"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only.

1. A slim table of keys and sizes is written once (texts are never shuffled).
2. A size-weighted sample of keys is drawn: a row is taken with a probability in proportion to its size,
   decided by a hash of its key, ``per_range`` rows for each range on average. The quantiles of the sorted
   sample, at most some thousands of keys, are the splitters.
3. Rows fall into ranges by a binary search in the splitters. Exact bytes and rows of every range are
   counted; ranges that hold more than ``overfull`` times their share get splitters of their own from a
   sample drawn inside them, until none is left.
4. Running sums inside a range (a window over one range, so of bounded size however the keys are spread)
   plus the ranges' offsets give every row its exact place in key order. The middle of its bytes decides its
   shard, so a shard's size is off its share by no more than one row; its slot counts from the shard's start.

The key is the document id, then a hash of the text, then a row number that is fixed when the slim table is
written, so rows of one id or equal rows can be split as well: a hot id or group of copies never meets in
one range.

Law: ``bytes``; ``grown_shard`` is null. Size: UTF-8 bytes of the text plus ``overhead``; null has none.
Defined cases: a null id comes first; repeated rows each have their slot; empty and very long texts are rows
like others (a text larger than a shard's share leaves neighbours short); an empty table gives an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medledger.session import cut_lineage

OVERHEAD = 16
RANGES_PER_SHARD = 4
PER_RANGE = 32
OVERFULL = 2.0
ROUNDS = 8

Key = tuple[int, int, int]
_KEY = ("o", "tie", "row")


def _range_of(splitters: list[Key]) -> Column:
    """The number of splitters that are not above a row's key, found by halving steps."""
    if not splitters:
        return F.lit(0)
    said = json.dumps([dict(zip(_KEY, k, strict=True)) for k in splitters])
    cuts = F.from_json(F.lit(said), f"array<struct<{','.join(f'{c}:bigint' for c in _KEY)}>>")  # folded into one literal
    key = F.struct(*_KEY)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at))


def _draw(rows: DataFrame, rate: Column, seed: int) -> list[tuple[Key, float]]:
    """Keys drawn with probability ``rate`` (their weight, where it is above 1), sorted."""
    chance = (F.xxhash64(F.lit(seed), *_KEY).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    drawn = rows.withColumn("w", rate).where(chance < F.col("w")).select(*_KEY, F.greatest(F.col("w"), F.lit(1.0)).alias("w"))
    return sorted(((r["o"], r["tie"], r["row"]), r["w"]) for r in drawn.collect())


def _quantiles(drawn: list[tuple[Key, float]], parts: int) -> list[Key]:
    """At most ``parts - 1`` keys that cut the drawn weight into equal parts."""
    total, upto, out = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        if int(upto * parts / total) < int((upto + w) * parts / total) and upto:
            out.append(key)
        upto += w
    return out


def splitters(slim: DataFrame, ranges: int, total: int, per_range: int = PER_RANGE, overfull: float = OVERFULL) -> tuple[list[Key], list[tuple[int, int]]]:
    """Splitters and, for each of their ranges, its exact bytes and rows."""
    cuts = _quantiles(_draw(slim, F.col("size") * F.lit(ranges * per_range / total), 1), ranges)
    share = total / ranges
    for turn in range(ROUNDS + 1):
        held = slim.groupBy(_range_of(cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        found = {r["range"]: (r["bytes"], r["rows"]) for r in held.collect()}
        sums = [found.get(i, (0, 0)) for i in range(len(cuts) + 1)]
        full = {i: b for i, (b, n) in enumerate(sums) if b > overfull * share and n > 1}
        if not full or turn == ROUNDS:
            return cuts, sums
        # Each overfull range gets about as many parts as it has shares.
        rate = F.create_map(*[F.lit(x) for i, b in full.items() for x in (i, 2 * per_range / share)])[F.col("range")]
        inside = slim.withColumn("range", _range_of(cuts)).where(F.col("range").isin(list(full)))
        drawn = _draw(inside, F.col("size") * rate, 2 + turn)
        more: list[Key] = []
        for i, b in full.items():
            low, high = (cuts[i - 1] if i else None), (cuts[i] if i < len(cuts) else None)
            part = drawn[(bisect_left(drawn, (low, 0.0)) if low else 0) : (bisect_left(drawn, (high, 0.0)) if high else len(drawn))]
            more += [k for k in _quantiles(part, int(2 * b / share) + 1) if k != low]
        if not more:
            return cuts, sums
        cuts = sorted({*cuts, *more})
    raise AssertionError


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD,
           per_range: int = PER_RANGE) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    told = F.coalesce(F.col(text), F.lit(""))
    slim = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(told) + overhead).cast("long").alias("size"),
        F.crc32(told).alias("text_crc32"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("o"),
        F.xxhash64(told).alias("tie"), F.monotonically_increasing_id().alias("row")))
    total = slim.agg(F.sum("size")).first()[0] or 1
    cuts, sums = splitters(slim, shards * RANGES_PER_SHARD, total, per_range)
    offsets, at_byte, at_row = [], 0, 0
    for i, (b, n) in enumerate(sums):
        offsets.append((i, at_byte, at_row))
        at_byte, at_row = at_byte + b, at_row + n
    # One row per range: the bound of this table is the number of splitters.
    before = F.broadcast(docs.sparkSession.createDataFrame(offsets, "range int, bytes_before long, rows_before long"))
    upto = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("range", _range_of(cuts)).select(
        "*", F.sum("size").over(upto).alias("bytes_here"), F.count(F.lit(1)).over(upto).alias("rows_here")).join(before, "range")
    twice_middle = 2 * (F.col("bytes_before") + F.col("bytes_here")) - F.col("size")
    placed = cut_lineage(placed.select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rows_here")).alias("place"),
        F.floor(twice_middle * shards / F.lit(2 * total)).cast("int").alias("shard")))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # at most one row per shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
