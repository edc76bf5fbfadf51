"""Vectorised word helpers shared by the text operators.

A *word* is a maximal run of ASCII letters and digits or of code points above U+007F, with A-Z
lower-cased (the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on the lower-cased text). In UTF-8
every byte of such a code point is above 0x7F, so words can be found and hashed on the bytes of an
Arrow string column without decoding it or making a Python object per word.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The word pattern, for SQL and brute-force versions.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18
_powers: tuple[np.ndarray, np.ndarray] | None = None


def words(text: Column) -> Column:
    """The words of a text as a native expression; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER_CASE), F.lit(f"({WORD_PATTERN})"))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: send it as a zip unless PYTHONPATH already names its folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in paths or getattr(sc, "_medledger_shipped", False):
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="medledger-code-")), "medledger.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "medledger")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    sc._medledger_shipped = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _SEGMENT * 2)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, np.uint64(base), dtype=np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.cumprod(t, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: Sequence[np.ndarray], fold: np.ndarray = TO_LOWER) -> list[np.ndarray]:
    """64-bit hashes of ``data[starts:e]`` for each ``e`` in ``ends`` (bytes mapped through ``fold``).

    A polynomial hash from prefix sums, so any number of slices costs one pass over the bytes. ``starts``
    ascend and no end lies beyond the next start's slice by more than a segment needs; works segment by
    segment to stay in cache.
    """
    out = [np.empty(len(starts), dtype=np.uint64) for _ in ends]
    if not len(starts):
        return out
    far = np.maximum.reduce([np.maximum.accumulate(e) for e in ends])
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(starts, base + _SEGMENT)))
            stop = int(far[j - 1])
            power, inverse = _power_tables(stop - base + 1)
            sums = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum((fold[data[base:stop]].astype(np.uint64) + np.uint64(1)) * power[: stop - base], out=sums[1:])
            s = starts[i:j] - base
            low, inv = sums[s], inverse[s]
            for h, e in zip(out, ends, strict=True):
                h[i:j] = mix((sums[e[i:j] - base] - low) * inv)
            i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its row offsets (rows + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a block of texts: byte slices, and the first word of each row in ``first`` (rows + 1)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.data, self.starts, [self.ends])[0]

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(column: pa.Array) -> Words:
    """Locate the words of every row."""
    data, offsets = text_bytes(column)
    inside = IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begin[cuts] = inside[cuts]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    finish[cuts[1:] - 1] = inside[cuts[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
