"""Lempel-Ziv phrase fingerprints of documents.

The UTF-8 bytes of a whole text are parsed as LZ78 does: a phrase is the shortest run from here on that is not in the
dictionary yet, and joins it. The phrases are hashed (64 bits, from prefix sums over the block), and the fingerprint is
the ``SIZE`` smallest 32-bit values of the set, ascending. Two fingerprints are compared by the share of common
values among the smallest ``SIZE`` of their union, an estimate of the phrase sets' Jaccard likeness (exact while
the union is no larger), which is high where one text's dictionary would compress the other.

``fingerprint`` works row by row and shuffles nothing. ``edited`` compares every document with an edit of it: its last
half replaced by the beginning of the next document in falling order of ids. For that, the texts are range-partitioned
by (id, hash of the text, row number) and sorted, each packed by zstandard, so that the next document is the next row; two rows of every
partition, its first and its last, are written with their texts and joined with the ones of the next partition. An
edited text shares its first half with its document, and so does its parse, which is carried on from there.

A worker holds a block of ``BLOCK_BYTES`` of text, a longer text alone, and the dictionary of one text.

Defined cases: a null text is an empty text; an empty text has the empty fingerprint, which is like another empty one
(1) and unlike all others (0); equal texts have equal fingerprints. ``edited``: null ids come last; rows of one id are
ordered by the XXH64 hash of their texts, so repeated rows follow each other; a lone document is its own next one; an
empty table gives an empty result. Only the named columns are read; ``fingerprint`` keeps all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medledger.llm.text import AS_IS, blocks, ship_package, slice_hashes
from medledger.session import cut_lineage

SIZE = 128
BLOCK_BYTES = 1 << 20


def parse(data: bytes, table: dict[int, int], node: int, at: int, ends: list[int]) -> int:
    """Go on with a parse: put the ends of new phrases (from ``at`` on) behind ``ends``; returns the open phrase.

    A phrase is a number; ``table`` gives the phrase that a byte makes of one.
    """
    get, new = table.get, ends.append
    for at, b in enumerate(data, at + 1):  # noqa: B020
        key = node << 8 | b
        node = get(key)
        if node is None:
            table[key] = len(table) + 1
            new(at)
            node = 0
    return node


def sketches(texts: list[bytes], ends: list[list[int]]) -> list[np.ndarray]:
    """The fingerprints of parsed texts (a text of a block may come twice, with another parse)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, stops, first = 0, [], [0]
    for text, end in zip(texts, ends, strict=True):
        stops.append(np.array(end, np.int64) + at)
        at += len(text)
        first.append(first[-1] + len(end))
    starts = [np.concatenate([[s[0] * 0 + a], s[:-1]]) if len(s) else s
              for s, a in zip(stops, np.cumsum([0, *map(len, texts)])[:-1].tolist(), strict=True)]
    hashes = slice_hashes(data, np.concatenate(starts), [np.concatenate(stops)], AS_IS)[0] if texts else np.zeros(0, np.uint64)
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        part = small[a:b]
        if b - a > 4 * SIZE:
            part = np.partition(part, 2 * SIZE)[: 2 * SIZE]  # equal values are few: phrases differ
            part = np.unique(part)
            if len(part) < SIZE:
                part = np.unique(small[a:b])
        else:
            part = np.unique(part)
        out.append(part[:SIZE])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common values among the ``SIZE`` smallest of two fingerprints' union."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    lead = np.concatenate([[True], ~twice])
    upto = np.cumsum(lead)
    kept = min(int(upto[-1]), SIZE)
    return float(np.count_nonzero(twice & (upto[1:] <= SIZE))) / kept


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The fingerprints of whole texts."""
    ends: list[list[int]] = []
    for text in texts:
        ends.append([])
        parse(text, {}, 0, 0, ends[-1])
    return sketches(texts, ends)


def written(values: np.ndarray) -> bytes:
    """A fingerprint as bytes: its values, four each, most significant first."""
    return values.astype(">u4").tobytes()


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with their fingerprints (lower-case hex) added."""
    ship_package(docs.sparkSession)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at, BLOCK_BYTES):
            told = [(t or "").encode() for t in block.column(at).to_pylist()]
            made = pa.array([written(v).hex() for v in fingerprints(told)], pa.string())
            yield pa.RecordBatch.from_arrays([*block.columns, made], names=[f"c{i}" for i in range(len(columns) + 1)])

    kind = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = docs.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, f"{kind}, c{len(columns)} string")
    return out.toDF(*columns, name)


def compared(texts: list[str], following: list[str]) -> list[tuple]:
    """(n_chars, digest of the edited text, fingerprint, edited fingerprint, likeness to the edit, to the next text) of
    each text and the one behind it. ``following[i]`` is ``texts[i + 1]``, but for the last."""
    own, edits, own_ends, edit_ends = [], [], [], []
    for text, after in zip(texts, following, strict=True):
        half = len(text) // 2
        head, tail, other = (x.encode() for x in (text[: len(text) - half], text[len(text) - half :], after[:half]))
        table: dict[int, int] = {}
        ends: list[int] = []
        node = parse(head, table, 0, 0, ends)
        fork, more = dict(table), list(ends)
        parse(tail, table, node, len(head), ends)
        parse(other, fork, node, len(head), more)
        own.append(head + tail)
        own_ends.append(ends)
        edits.append(head + other)
        edit_ends.append(more)
    last = following[-1].encode()
    own_ends.append([])
    parse(last, {}, 0, 0, own_ends[-1])
    found, changed = sketches([*own, last], own_ends), sketches(edits, edit_ends)
    return [(len(text), hashlib.sha256(edit).digest(), written(a), written(b), likeness(a, b), likeness(a, c))
            for text, edit, a, b, c in zip(texts, edits, found, changed, found[1:], strict=False)]


_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its edit and its successor: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next.

    The edit replaces the last ``floor(n_chars / 2)`` code points by as many (or all) from the beginning of the next
    document in falling order of ids; the first follows the last.
    """
    spark = docs.sparkSession
    ship_package(spark)
    told = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(told).alias("hash"), told.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for block in blocks(batches, 2, BLOCK_BYTES):
            packed = pa.array([squeeze(t.encode()) for t in block.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*block.columns[:2], packed], names=["doc_id", "hash", "packed"])

    order = (F.col("doc_id").desc_nulls_last(), F.col("hash"))
    packed = slim.mapInArrow(pack, f"doc_id {kind}, hash long, packed binary")
    ranged = packed.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    ranged = ranged.select("doc_id", "packed", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares all rows but the last; gives the first and the last with their texts."""
        unpack = zstandard.ZstdDecompressor().decompress
        ids: list = []
        texts: list[str] = []
        size, part, schema = 0, None, None
        for batch in batches:
            schema = batch.schema.field(0).type
            for name, row, at in zip(*batch.columns, strict=True):
                ids.append(name.as_py())
                texts.append(unpack(row.as_buffer()).decode())
                size += len(texts[-1])
                if part is None:
                    part = at.as_py()
                    yield _edge([None], texts, part, "first", schema)
                if size > BLOCK_BYTES and len(texts) > 1:
                    yield _found(ids[:-1], compared(texts[:-1], texts[1:]), part, schema)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield _found(ids[:-1], compared(texts[:-1], texts[1:]), part, schema)
        if texts:
            yield _edge(ids[-1:], texts[-1:], part, "last", schema)

    held = cut_lineage(ranged.mapInArrow(run, f"doc_id {kind}, {_RESULT}, part int, edge string, text string"))
    ends = held.where("edge IS NOT NULL").select("edge", "part", "doc_id", "text")  # two rows a partition
    parts = sorted(r["part"] for r in ends.where("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    last = ends.where("edge = 'last'").select("part", "doc_id", "text").join(after, "part")
    pairs = last.join(ends.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                made = compared(row.column(1).to_pylist(), row.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([row.column(0), *_columns(made)], names=["doc_id", *[f"c{i}" for i in range(len(_KINDS))]])

    closed = pairs.select("doc_id", "text", "following").mapInArrow(close, f"doc_id {kind}, {_RESULT}")
    both = held.where("edge IS NULL").select(*closed.columns).unionByName(closed)
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def _found(ids: list, rows: list[tuple], part: int, kind: pa.DataType) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(ids, kind), *_columns(rows), pa.array([part] * n, pa.int32()), *[pa.nulls(n, pa.string())] * 2]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def _edge(ids: list, texts: list[str], part: int, edge: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(ids, kind), *[pa.nulls(1, k) for k in _KINDS], *(pa.array([x], k) for x, k in ((part, pa.int32()), (edge, pa.string()), (texts[0], pa.string())))]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
