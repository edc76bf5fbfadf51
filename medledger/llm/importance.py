"""Importance resampling towards a target distribution, with exact ranks from parallel sorting by regular sampling.

Features are all runs of one to three consecutive words, hashed into ``BUCKETS`` buckets (CRC-32 of their bytes,
joined by one space). A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus;
a document's weight is the sum over its features, an array lookup each. A Gumbel value of the document's id is
added, so the highest scores are a draw without replacement in proportion to the weights' exponentials.

Checksums are taken once a word and joined: ``crc(AB) = shift(crc(A), len B) ^ crc(B)``, where the shift is linear
and looked up by length, so that no feature is ever built as a string.

Ranks: the scored rows (slim, no texts) are written once. Runs, at most ``RUNS``, are sorted locally and give
regular samples, every 2^k-th row, of which the driver holds at most ``2 * RUNS`` a run. Their quantiles cut the
order into ranges; the segments of the runs are exchanged by range and merged there, and the counts of the ranges
before, one number a range, give every row its exact rank. The order is total (score, id, features, row number), so a
crowd of equal rows is cut like any other.

Corpus counts cover all rows (one row a bucket and task is shuffled). Texts are read twice and never shuffled.

Defined cases: a null or empty text has no words, no features and weight 0; rows of fewer than ``MIN_WORDS`` words
take no part in the draw; rows of one id draw the same Gumbel value, as the id alone decides it, a null id that of
the empty string, and comes last among equal scores; repeated rows are rows; an empty table gives an empty result.
Ids are integers or strings. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medledger.llm.text import TO_LOWER, Words, blocks, find_words, ship_package
from medledger.session import cut_lineage

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Runs and ranges at most, and regular samples a run at least.
RUNS = 1_000
BLOCK_BYTES = 1 << 20
#: Words hashed at once; a longer text is worked through in segments.
SEGMENT = 1 << 18
_NEAR = 64


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of a byte; shifts by 0 to 63 bytes; shifts by 64, 128, 256, ... bytes (each four tables of 256)."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = []
    for _ in range(_NEAR):
        near.append(now)
        now = byte[now & 255] ^ (now >> 8)
    far = [now]
    while len(far) < 32:
        far.append(_apply(far[-1], far[-1]))
    return byte, np.stack(near), np.stack(far)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


BYTE, NEAR, FAR = _crc_tables()
_FLAT = [np.ascontiguousarray(NEAR[:, k, :]).ravel() for k in range(4)]
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part that a checksum has in the one of its text with ``size`` bytes more."""
    row = (size & (_NEAR - 1)) << 8
    out = _FLAT[0][row + (crc & 255)] ^ _FLAT[1][row + ((crc >> 8) & 255)] ^ _FLAT[2][row + ((crc >> 16) & 255)] ^ _FLAT[3][row + (crc >> 24)]
    rest, k = size >> 6, 0
    while rest.any():
        on = np.flatnonzero(rest & 1)
        out[on] = _apply(FAR[k], out[on])
        rest, k = rest >> 1, k + 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, lower-cased, a byte of all words at a time; words of 64 bytes and more one by one."""
    out = np.zeros(len(starts), np.uint32)
    at = np.flatnonzero(size < _NEAR)
    place, left, crc = starts[at], size[at], np.full(len(at), 0xFFFFFFFF, np.uint32)
    while len(at):
        crc = BYTE[(crc ^ TO_LOWER[data[place]]) & 255] ^ (crc >> 8)
        place, left = place + 1, left - 1
        ended = left == 0
        out[at[ended]] = ~crc[ended]
        go = ~ended
        at, place, left, crc = at[go], place[go], left[go], crc[go]
    for i in np.flatnonzero(size >= _NEAR):
        out[i] = zlib.crc32(TO_LOWER[data[starts[i] : starts[i] + size[i]]].tobytes())
    return out


def features(found: Words, buckets: int = BUCKETS) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Segments of words: the first word, and for runs of one, two and three words the buckets of the runs that begin
    at each word and whether there is one (it ends in the same row)."""
    n, row = len(found.starts), found.rows()
    for a in range(0, n, SEGMENT):
        b, c = min(n, a + SEGMENT), min(n, a + SEGMENT + 2)
        size = found.ends[a:c] - found.starts[a:c]
        one = word_crcs(found.data, found.starts[a:c], size)
        spaced = shifted(np.full(len(one), _SPACE, np.uint32), size) ^ one  # of a space and the word
        crcs, there, last = [], [], one
        for k in range(3):
            last = last if not k else shifted(last[: len(one) - k], size[k:] + 1) ^ spaced[k:]
            held = last[: b - a]
            crcs.append((held % np.uint32(buckets)).astype(np.int64))
            there.append(row[a + k : a + k + len(held)] == row[a : a + len(held)])
        yield a, crcs, there


def _counts(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for block in blocks(batches, 0, BLOCK_BYTES):
            for _, crcs, there in features(find_words(block.column(0)), buckets):
                for bucket, ok in zip(crcs, there, strict=True):
                    sums += np.bincount(bucket[ok], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    held = texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in held.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, wanted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` over all features of the corpus
    (s in the bucket, S in all) and of the target (t, T)."""
    ship_package(docs.sparkSession)
    s, t = (_counts(df, text, buckets).tolist() for df in (docs, wanted))
    corpus, target = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(((y + 1.0) * corpus) / ((x + 1.0) * target))) for x, y in zip(s, t, strict=True)], np.int64)


def gumbel(doc_id, seed: int = SEED) -> int:
    """``floor(-1000 ln(-ln u))`` of a uniform value that the seed and the id fix."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight and score (long)."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for block in blocks(batches, 1, BLOCK_BYTES):
            found = find_words(block.column(1))
            upto, many = np.zeros(len(found.starts) + 1, np.int64), np.diff(found.first)
            for a, crcs, there in features(found, len(gain)):
                part = np.zeros(len(crcs[0]), np.int64)
                for bucket, ok in zip(crcs, there, strict=True):
                    part[: len(bucket)] += np.where(ok, gain[bucket], 0)
                upto[a + 1 : a + 1 + len(part)] = upto[a] + np.cumsum(part)
            weight = np.diff(upto[found.first])
            chance = np.array([gumbel(d, seed) for d in block.column(0).to_pylist()], np.int64)
            runs = many + np.maximum(many - 1, 0) + np.maximum(many - 2, 0)
            yield pa.RecordBatch.from_arrays([block.column(0), *map(pa.array, (many.astype(np.int64), runs.astype(np.int64), weight, weight + chance))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


_KEY = ("down", "lost", "doc_id", "n_features", "row")


def _sampled(runs: DataFrame, per_run: int, kind: str) -> list[tuple[tuple, int]]:
    """Regular samples of sorted runs, sorted: keys and how many rows each stands for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride, seen, held = 1, 0, []
        for batch in batches:
            at = np.arange(-seen % stride, batch.num_rows, stride)
            seen += batch.num_rows
            if len(at):
                held.append(batch.take(pa.array(at)))
            while sum(h.num_rows for h in held) > 2 * per_run:
                merged = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, stride = [merged.take(pa.array(np.arange(0, merged.num_rows, 2)))], stride * 2
        for h in held:
            yield h.append_column("rows", pa.array(np.full(h.num_rows, stride, np.int64)))

    drawn = runs.select(*_KEY).mapInArrow(run, f"down long, lost boolean, doc_id {kind}, n_features long, row long, rows long")
    first = lambda k: (k[0][0], k[0][1], *(() if k[0][1] else (k[0][2],)), *k[0][3:])
    return sorted(((tuple(r)[:-1], r["rows"]) for r in drawn.collect()), key=first)


def _range_of(cuts: list[tuple], kind: str) -> Column:
    """The number of cuts that are not above a row's key, by halving steps in one folded literal."""
    if not cuts:
        return F.lit(0)
    said = json.dumps([dict(zip(_KEY, c, strict=True)) for c in cuts])
    held = F.from_json(F.lit(said), f"array<struct<down:bigint,lost:boolean,doc_id:{kind},n_features:bigint,row:bigint>>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= F.struct(*_KEY), at + step).otherwise(at))


def ranked(scored: DataFrame, ranges: int | None = None) -> DataFrame:
    """``scored`` (as ``score`` gives it) with ``rank``: 1, 2, ... by falling score, then smaller id.

    A written table may bring its own fixed and unique number ``row``; otherwise one is added and the rows are written.
    """
    spark = scored.sparkSession
    ranges = min(RUNS, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = scored.schema["doc_id"].dataType.simpleString()
    rows = scored if "row" in scored.columns else cut_lineage(scored.withColumn("row", F.monotonically_increasing_id()))
    keyed = rows.withColumns({"down": -F.col("score"), "lost": F.col("doc_id").isNull()})
    runs = keyed.coalesce(ranges).sortWithinPartitions(*_KEY)
    drawn = _sampled(runs, ranges, kind)
    total, upto, cuts = sum(n for _, n in drawn), 0, []
    for key, n in drawn:
        if upto and upto * ranges // total < (upto + n) * ranges // total:
            cuts.append(key)
        upto += n
    placed = runs.withColumn("range", _range_of(cuts, kind))
    counts = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a range
    before, upto = {}, 0
    for k in range(len(cuts) + 1):
        before[k], upto = upto, upto + counts.get(k, 0)
    exchanged = placed.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", *_KEY)

    names = [*scored.columns, "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            rank = np.zeros(len(part), np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if part[a] != now:
                        now, at = int(part[a]), before[int(part[a])]
                    rank[a:b] = np.arange(at + 1, at + 1 + b - a)
                    at += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rank)], names=names)

    out = exchanged.select("range", *scored.columns)
    return out.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields) + ", rank long")


def resample(docs: DataFrame, wanted: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
             min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every document: doc_id, n_words, n_features, weight, score and rank, which is null where it is not drawn.

    ``percent`` of the documents of at least ``min_words`` words (rounded down) are drawn.
    """
    scored = cut_lineage(score(docs, gains(docs, wanted, text, buckets), doc_id, text, seed).withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked(scored.where(able)).withColumn("rank", rank).unionByName(
        scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop("row")
