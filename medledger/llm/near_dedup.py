"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of hashes of its five-word shingles (fewer words: one shingle of all of them); a
shingle's weight is how often the document has it. The similarity of two documents is their weighted Jaccard similarity:
the sum of smaller weights over the sum of larger ones.
DartMinHash throws darts into the region of every element, its weight wide and open in rank: the region is
cut into cells, each with a hashed Poisson number of darts, the same for every document, so a
document needs only the darts below a rank that grows as it gets smaller. Each dart falls on one of
``coordinates`` places, the earliest dart of a place is its signature there, and two documents agree at
a place with probability of their weighted Jaccard similarity, for any weights. The cost is about one
dart per element plus ``k ln k`` per document. Bands of ``rows`` places are the join keys: with 40 bands
of 6, a pair of similarity 0.8 shares no band with a probability of 5e-6.

Band keys only propose; the exact similarity of the weighted sets decides. The result is the connected
components of all pairs at or above the threshold that share a band, found without listing the pairs
of a bucket:

1. Documents with the same shingle set are one class before anything is joined (map-side combined).
2. Each class is compared with one leader, the member of its buckets with the most band mates, so that a
   large group of near copies falls together in one linear pass; components follow.
3. Only pairs of a bucket from different components are left. Their classes get a longer signature, of
   ``SKETCH`` places with one bit each, and a pair is refused in the join itself if its bits differ at
   more places than six deviations allow at the threshold (a pair at 0.8 is refused with a probability
   of 1e-9). The rest, few beyond the true links, are compared, and components follow again.

Components are found by alternating large and small stars, as joins and minima over edge tables, with
each round written to the shared checkpoint folder. Shingle sets move only for classes that share a band
with another.

Defined cases: texts without words are one group per equal text (null is empty); repeated rows and repeated
ids are classed row by row by their text; an empty table gives an empty result. In ``classes`` a null id
belongs to no group and its class is null. ``dedup`` groups all rows, whatever their ids, and keeps exactly
one row of each group: the one with the smallest id, rows without an id last, then by a hash of id and text. Only
the two named columns are read; ``dedup`` returns all columns of its input, whatever their names. Sets and
classes are told apart by 64-bit hashes together with their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medledger.llm.text import blocks, find_words, mix, ship_package, text_bytes
from medledger.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 40, 6
#: Places of the one-bit signatures that refuse pairs (a multiple of 64).
SKETCH = 2048
#: Similarity of at least 0.8 as a fraction.
OVER, UNDER = 4, 5
BLOCK_BYTES = 1 << 20
#: Darts thrown at once.
DARTS = 1 << 17

_U = np.uint64
_STEP, _WEIGHT = _U(0xA24BAED4963EE407), _U(0xD6E8FEB86659FD93)
_LOW, _HALF = _U(0xFFFFFFFF), _U(32)
#: Hashes from which on a cell of area 1 holds more than 0, 1, 2... darts: the Poisson distribution of mean 1.
_POISSON = np.array([int(2**64 * sum(exp(-1) / factorial(j) for j in range(n + 1))) for n in range(16)], _U)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row, the first of each row (rows + 1), and how often each is there."""
    found = find_words(texts)
    h, rows = found.hashes(), len(found.first) - 1
    count = np.diff(found.first)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(rows), made)
    at = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + found.first[:-1][row]
    out = np.zeros(len(row), _U)
    end = found.first[1:][row]
    with np.errstate(over="ignore"):
        for j in range(size):
            inside = at + j < end
            out = np.where(inside, mix(out * _U(0x100000001B3) + h[np.minimum(at + j, max(len(h) - 1, 0))]) if len(h) else out, out)
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    times = np.diff(np.concatenate([np.flatnonzero(keep), [len(keep)]]))
    row, out = row[keep], out[keep]
    return out, np.searchsorted(row, np.arange(rows + 1)), times


def _totals(times: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The weight of each row."""
    upto = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
    return upto[first[1:]] - upto[first[:-1]]


def _darts(element: np.ndarray, weight: np.ndarray, since: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the element, rank, id) of the darts of each element with ranks from ``since`` to ``limit`` at least.

    The weight axis is cut at 1, 2, 4, 8... and a column of width d at ranks 1/d, 2/d, 3/d..., into cells of area 1. A
    cell holds a hashed Poisson number of darts, each on a hashed rank and weight; those beyond the element's
    weight are not kept. Cells are thrown whole, so some darts lie outside of the asked ranks.
    """
    column, low, high = 0, 0.0, 1.0
    live = np.arange(len(element))
    while len(live):
        width = high - low
        begin, end = np.floor(since[live] * width).astype(np.int64), np.ceil(limit[live] * width).astype(np.int64)
        cells = end - begin
        upto = np.cumsum(cells)
        of = np.repeat(np.arange(len(live)), cells)
        cell = np.arange(len(of)) - np.repeat(upto - cells - begin, cells)
        with np.errstate(over="ignore"):
            seed = mix(element[live] ^ mix(np.array([column], _U))[0])
            held = mix(seed[of] + _STEP * cell.astype(_U))
            darts = np.searchsorted(_POISSON, held, side="right")
            order = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(np.repeat(held, darts) + _STEP * (order + 1).astype(_U))
        index = np.repeat(live[of], darts)
        rank = (np.repeat(cell, darts) + (dart & _LOW).astype(np.float64) * 2.0**-32) / width
        if (weight[live] < high).any():
            at = low + (mix(dart ^ _WEIGHT) >> _U(11)).astype(np.float64) * 2.0**-53 * width
            hit = at < weight[index]
            index, rank, dart = index[hit], rank[hit], dart[hit]
        yield index, rank, dart
        column, low, high = column + 1, high, high * 2
        live = live[weight[live] > low]


def signatures(element: np.ndarray, first: np.ndarray, coordinates: int, weight: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash signatures (rows x coordinates) of weighted sets; a row without elements gets zeros.

    A place's value is the id of the earliest dart on it over all ranks: rows with an empty place throw
    on, from the rank that they have reached to half as much again. Rows are handled in groups of about ``DARTS`` darts.
    """
    rows = len(first) - 1
    weight = np.ones(len(element)) if weight is None else weight
    total = np.diff(np.concatenate([[0.0], np.cumsum(weight)])[first])
    need = coordinates * (np.log(coordinates) + 2.0)
    out = np.zeros((rows, coordinates), _U)
    some = np.flatnonzero(total > 0)
    cost = np.cumsum(need + total[some])
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0.0) + DARTS, side="right")))
        _sign_rows(element, first, weight, some[at:end], _whole(need / total[some[at:end]]), out)
        at = end
    return out


def _whole(limit: np.ndarray) -> np.ndarray:
    """Ranks rounded up to whole cells of every column, where they reach one."""
    return np.where(limit > 1, np.ceil(limit), limit)


def _sign_rows(element: np.ndarray, first: np.ndarray, weight: np.ndarray, todo: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    """Fill in the signatures of the rows ``todo``."""
    coordinates = out.shape[1]
    since = np.zeros(len(todo))
    best, value = np.full((len(todo), coordinates), np.inf), np.zeros((len(todo), coordinates), _U)
    while len(todo):
        size = np.diff(first)[todo]
        local = np.repeat(np.arange(len(todo)), size)
        at = np.arange(len(local)) + np.repeat(first[todo] - np.cumsum(size) + size, size)
        earliest, ids = best.ravel(), value.ravel()
        for of, rank, dart in _darts(element[at], weight[at], since[local], limit[local]):
            place = local[of] * coordinates + (((dart >> _HALF) * _U(coordinates)) >> _HALF).astype(np.int64)
            np.minimum.at(earliest, place, rank)
            lead = rank == earliest[place]
            ids[place[lead]] = dart[lead]
        full = (best < limit[:, None]).all(axis=1)
        out[todo[full]] = value[full]
        todo, since, best, value = todo[~full], limit[~full], best[~full], value[~full]
        limit = _whole(since * 1.5)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    key = np.tile(mix(np.arange(bands, dtype=_U)), (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix(key * _U(0x100000001B3) + parts[:, :, j])
    return key


def _set_keys(sets: np.ndarray, first: np.ndarray, times: np.ndarray, texts: pa.Array) -> np.ndarray:
    """A 64-bit key per row of its weighted shingle set, or of its bytes if it has no word."""
    size = np.diff(first)
    with np.errstate(over="ignore"):
        mixed = mix(mix(sets + mix(times.astype(_U))) * _U(0x9E3779B97F4A7C15))
        total = np.concatenate([[_U(0)], np.cumsum(mixed, dtype=_U)])
        key = mix((total[first[1:]] - total[first[:-1]]) + size.astype(_U))
    bare = np.flatnonzero(size == 0)
    if len(bare):
        data, offsets = text_bytes(texts)
        key[bare] = [xxhash.xxh64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes()) for i in bare]
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1, BLOCK_BYTES):
        sets, first, times = shingles(block.column(1))
        size = _totals(times, first)
        keys = band_keys(signatures(sets, first, BANDS * ROWS, times.astype(np.float64))).view(np.int64)
        some = np.flatnonzero(size)
        cut = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.array(_set_keys(sets, first, times, block.column(1))), pa.array(size, pa.int64()),
             pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(keys[some].ravel())), *block.columns[2:]],
            names=["doc_id", "key", "n", "bands", *block.schema.names[2:]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1, BLOCK_BYTES):
        sets, first, times = shingles(block.column(1))
        raw = [_packed(sets[a:b], times[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_set_keys(sets, first, times, block.column(1))), pa.array(raw, pa.binary())], names=["key", "shingles"])


def _packed(sets: np.ndarray, times: np.ndarray) -> bytes:
    """A weighted set as bytes: how many shingles are there more than once, where they are and how often, then all shingles."""
    more = np.flatnonzero(times > 1)
    return np.concatenate([np.array([len(more)]), more, times[more]]).astype("<i8").tobytes() + sets.tobytes()


def _unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    more = int(raw[0])
    times = np.ones(len(raw) - 1 - 2 * more, np.int64)
    times[raw[1 : 1 + more].view(np.int64)] = raw[1 + more : 1 + 2 * more].view(np.int64)
    return raw[1 + 2 * more :], times


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            (x, m), (y, n) = (_unpacked(np.frombuffer(s.as_buffer(), _U)) for s in (x, y))
            _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = int(np.minimum(m[at], n[to]).sum())
            keep.append(both * UNDER >= OVER * (int(m.sum()) + int(n.sum()) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest bit of every place of a long signature, 64 to a number."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            part = batch.slice(at, 16)
            sets, times = zip(*[_unpacked(np.frombuffer(x.as_buffer(), _U)) for x in part.column(1)], strict=True)
            first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            bits = (signatures(np.concatenate(sets), first, SKETCH, np.concatenate(times).astype(np.float64)) & _U(1)).astype(np.uint8)
            words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            cut = pa.array(np.arange(part.num_rows + 1) * words.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(cut, pa.array(words.ravel()))], names=["key", "sketch"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted sets reach the threshold."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge table; the root is the smallest node of its component.

    Alternates large stars (each node hands its larger neighbours to its smallest one) and small stars
    (each node hands its smaller neighbours to the smallest) until the edges no longer change.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = cut_lineage(e), None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("s")).first()
        if not state["n"] or state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id (long), class_id (smallest doc_id of its group), n_shingles (repeated ones each)."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(slim.mapInArrow(_sign, "doc_id long, key long, n long, bands array<long>"))
    whole = signed.where("doc_id IS NOT NULL")
    rooted = _rooted(slim, whole)
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    names = cut_lineage(rooted.join(least, "root").select("key", "class_id"))
    out = signed.join(names, "key", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    return out.select("doc_id", "class_id", F.col("n").alias("n_shingles"))


def _rooted(slim: DataFrame, whole: DataFrame) -> DataFrame:
    """key, least (its smallest doc_id) and root (the key its group is told by) of every set key of ``whole``, which has the signatures of ``slim``."""
    rep = whole.groupBy("key", "n").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    rep = rep.where("n > 0").select("key", "n", F.col("r.doc_id").alias("doc_id"), F.explode("r.bands").alias("bucket"))
    bands = cut_lineage(rep)
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = cut_lineage(bands.join(shared, "bucket"))
    # One leader per class: the class of its buckets with the most band mates.
    popular = live.groupBy("key").agg(F.sum("size").alias("mates"))
    known = live.select("bucket", "key").join(popular, "key")
    leader = known.groupBy("bucket").agg(F.max(F.struct("mates", F.col("key").alias("leader"))).alias("l"))
    star = live.select("bucket", "key").join(leader, "bucket").groupBy("key").agg(F.max("l").alias("l"))
    star = star.select(F.col("key").alias("a"), F.col("l.leader").alias("b")).where("a <> b")
    ids = cut_lineage(live.select("doc_id").distinct())
    keys = live.select("key").distinct()
    sets = slim.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "key long, shingles binary").join(keys, "key", "left_semi")
    sets = cut_lineage(sets.groupBy("key").agg(F.min("shingles").alias("shingles")))
    links = cut_lineage(_linked(star, sets))
    group = components(links)
    # What is left: pairs of a bucket from different components.
    placed = live.select("bucket", "key", "n").join(group.withColumnRenamed("node", "key"), "key", "left")
    placed = cut_lineage(placed.select("bucket", "key", "n", F.coalesce("root", "key").alias("root")))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    contested = cut_lineage(placed.join(mixed, "bucket"))
    bits = sets.join(contested.select("key").distinct(), "key", "left_semi").mapInArrow(_sketch, "key long, sketch array<long>")
    held = contested.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))  # at most one per band
    pairs = _across(contested.join(bits.join(held, "key"), "key"))
    more = cut_lineage(_linked(pairs, sets))
    group = components(links.union(more))
    rooted = whole.groupBy("key").agg(F.min("doc_id").alias("least")).join(group.withColumnRenamed("node", "key"), "key", "left")
    return cut_lineage(rooted.select("key", "least", F.coalesce("root", "key").alias("root")))


def _across(contested: DataFrame) -> DataFrame:
    """Pairs of classes that share a bucket, are of different components and may reach the threshold.

    A pair with several common buckets comes out of the smallest of them only.
    """
    x, y = contested.alias("x"), contested.alias("y")
    # Two bits differ at half of the places that differ: a share of (1 - 0.8) / 2 at the threshold.
    share = (UNDER - OVER) / UNDER / 2
    most = int(SKETCH * share + 6 * (SKETCH * share * (1 - share)) ** 0.5)
    apart = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    sizes = F.least("x.n", "y.n") * UNDER >= F.greatest("x.n", "y.n") * OVER
    once = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")
    both = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
                  & sizes & (apart <= most) & once)
    return both.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: the smallest id, rows without an id last, then by a hash of id and text; of rows equal in both, one."""
    ship_package(docs.sparkSession)
    columns = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # any input names will do
    real, told = F.col(f"c{columns.index(doc_id)}").cast("long"), F.col(f"c{columns.index(text)}")
    who = F.xxhash64(real, told)
    slim = inner.select(who.alias("doc_id"), told.alias("text"))  # never null, and apart for rows of one id with different texts
    signed = inner.select(who.alias("doc_id"), told.alias("text"), real.alias("id"))
    signed = cut_lineage(signed.mapInArrow(_sign, "doc_id long, key long, n long, bands array<long>, id long"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("who"))
    best = signed.groupBy("key").agg(F.min(first).alias("first")).join(_rooted(slim, signed).select("key", "root"), "key")
    kept = cut_lineage(best.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.who").alias("kept")))
    some = inner.withColumns({"who": who, "id": real, "row": F.monotonically_increasing_id()})
    some = some.join(kept, (F.col("who") == F.col("kept")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    one = some.groupBy("who", "id").agg(F.min_by(F.struct(*inner.columns), "row").alias("r"))
    return one.select("r.*").toDF(*columns)
