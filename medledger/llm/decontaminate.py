"""Benchmark decontamination by suffix arrays over the training texts.

Every shard (a block of training documents of a few megabytes) gets a suffix array over its words.
Every suffix of every benchmark item is searched in it by bisection, one word deeper at a time, until
its range of suffixes is empty: the last non-empty range is its longest verbatim match in the shard and
holds all locations of it. Ranges at the window length mark the contaminated words. Shards are Arrow
blocks inside tasks, so nothing is shuffled; the training text is read once per pass.

The benchmark travels as a broadcast of word codes. Its size is bounded: at most ``pass_bytes`` of
item text go into one pass, and a larger benchmark takes several passes over the documents, whose
findings are written to a table between passes and merged per document.

Words are compared as 64-bit hashes of their bytes, so a false match of one word with another has a
chance of about 2**-64 per pair.

Defined cases: a null or empty text has no words and is never contaminated; a benchmark item without
words takes no part; an item of fewer than ``window`` words is one window; a null item id is listed as
``null``; repeated items count once per distinct id; repeated documents are scanned and returned row by
row; empty tables give empty results (no benchmark: nothing is hit). Input columns other than the text
pass through untouched in ``decontaminate``; ``scan`` reads only the two columns it is given, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medledger.llm.text import blocks, find_words, ship_package
from medledger.session import cut_lineage

WINDOW = 13
SHARD_BYTES = 2 << 20
PASS_BYTES = 16 << 20
#: A document is contaminated when at least one word in ``RATIO`` is hit.
RATIO = 20

SCAN_TYPE = "n_words:bigint,n_hit:bigint,longest:bigint,items:array<string>,spans:array<struct<start:bigint,stop:bigint>>"


class Benchmark:
    """Word codes of benchmark items, their suffixes and their distinct windows."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        found = find_words(pa.array(texts, pa.large_string()))
        self.words = found.hashes()
        sizes = np.diff(found.first)
        self.ids = ["null" if i is None else str(i) for i in ids]
        self.item = found.rows()
        self.left = found.first[1:][self.item] - np.arange(len(self.words))  # words from here to the item's end
        self.offset = sizes[self.item] - self.left  # of the suffix in its item
        self.deepest = int(sizes.max(initial=0))
        # The window that begins at a suffix: 13 words, or the whole of a shorter item.
        whole = (self.left == sizes[self.item]) & (self.left < window)
        self.span = np.where(self.left >= window, window, np.where(whole, self.left, 0))
        # Equal windows share one representative; each keeps all its items.
        seen: dict[bytes, int] = {}
        self.holders: dict[int, set[str]] = {}
        self.lead = np.zeros(len(self.words), dtype=bool)
        for at in np.flatnonzero(self.span):
            lead = seen.setdefault(self.words[at : at + self.span[at]].tobytes(), int(at))
            self.lead[lead] = True
            self.holders.setdefault(lead, set()).add(self.ids[self.item[at]])


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``symbols`` (small non-negative integers, of which 0 ends a text) sorted by their next
    ``depth`` symbols; what follows a 0 does not matter.

    The first key packs as many symbols as 63 bits hold; after that the sorted prefix doubles, and only
    positions that still tie are sorted again.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(symbols.max()).bit_length())
    known = max(1, min(depth, 63 // bits))
    padded = np.concatenate([symbols, np.zeros(known, symbols.dtype)]).astype(np.uint64)
    key = padded[:n].copy()
    for j in range(1, known):
        key <<= np.uint64(bits)
        key |= padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    while known < depth:
        tied = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
        if not len(tied):
            break
        at = order[tied]
        ahead = np.where(at + known < n, rank[np.minimum(at + known, n - 1)] + 1, 0)
        pair = head[tied] * (n + 2) + ahead
        again = np.argsort(pair)
        at, pair = at[again], pair[again]
        order[tied] = at
        fresh[tied] = np.concatenate([[True], pair[1:] != pair[:-1]])
        head[tied] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        rank[at] = head[tied]
        known *= 2
    return order


class Shard:
    """A suffix array over the words of a block of documents, and searches in it."""

    def __init__(self, texts: pa.Array, depth: int):
        self.found = find_words(texts)
        codes = pa.array(self.found.hashes()).dictionary_encode()
        self.vocabulary = codes.dictionary
        rows = len(self.found.first) - 1
        # Symbol 0 ends each document, so that no match runs into the next one.
        self.starts = self.found.first[:-1] + np.arange(rows)
        self.symbols = np.zeros(len(self.found.starts) + rows, np.int64)
        self.place = np.arange(len(self.found.starts)) + self.found.rows()
        self.symbols[self.place] = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.order = suffix_array(self.symbols, depth)
        counts = np.bincount(self.symbols, minlength=len(self.vocabulary) + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
        """In each range of suffixes, the first whose symbol at ``depth`` is not below ``want``."""
        low, high = low.copy(), high.copy()
        last = len(self.symbols) - 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            less = self.symbols[np.minimum(self.order[middle] + depth, last)] < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every benchmark suffix: its longest match and first location, and its window's range of suffixes."""
        n = len(bench.words)
        longest, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        first, stop = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.symbols):
            return longest, where, first, stop
        code = pc.index_in(pa.array(bench.words), value_set=self.vocabulary)
        symbol = code.fill_null(len(self.vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        live = np.arange(n)
        low, high = self.before[symbol], self.before[symbol + 1]
        for depth in range(1, bench.deepest + 1):
            kept = low < high
            live, low, high = live[kept], low[kept], high[kept]
            if not len(live):
                break
            longest[live], where[live] = depth, self.order[low]
            at = bench.span[live] == depth
            first[live[at]], stop[live[at]] = low[at], high[at]
            more = bench.left[live] > depth
            live, low, high = live[more], low[more], high[more]
            want = symbol[live + depth]
            low, high = self._bound(low, high, depth, want), self._bound(low, high, depth, want + 1)
        return longest, where, first, stop

    def findings(self, bench: Benchmark) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Per document: ids of items with occurring windows, and starts and stops of its hit words."""
        rows = len(self.starts)
        out: list = [((), np.zeros(0, np.int64), np.zeros(0, np.int64))] * rows
        _, _, first, stop = self.search(bench)
        leads = np.flatnonzero(bench.lead & (first < stop))
        if not len(leads):
            return out
        count = (stop - first)[leads]
        which = np.repeat(leads, count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = self.order[first[which] + step]
        edge = np.bincount(at, minlength=len(self.symbols) + 1)
        edge = edge - np.bincount(at + bench.span[which], minlength=len(self.symbols) + 1)
        hit = np.cumsum(edge) > 0
        turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        # Runs cannot cross documents: the symbol that ends each document is never hit.
        doc_of_run = np.searchsorted(self.starts, begin, side="right") - 1
        doc_of_hit = np.searchsorted(self.starts, at, side="right") - 1
        pairs = np.unique(np.stack([doc_of_hit, which], axis=1), axis=0)
        run_cut = np.searchsorted(doc_of_run, np.arange(rows + 1))
        pair_cut = np.searchsorted(pairs[:, 0], np.arange(rows + 1))
        for d in np.unique(doc_of_run):
            items = set().union(*(bench.holders[int(w)] for w in pairs[pair_cut[d] : pair_cut[d + 1], 1]))
            runs = slice(run_cut[d], run_cut[d + 1])
            out[d] = (sorted(items), begin[runs] - self.starts[d], end[runs] - self.starts[d])
        return out


def _merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as disjoint spans."""
    if len(starts) < 2:
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > stops[:-1]])
    return starts[new], stops[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stops) - 1]])]


def _passes(benchmark: DataFrame, item_id: str, text: str, window: int, pass_bytes: int) -> Iterator[Benchmark]:
    """The benchmark in parts of at most ``pass_bytes`` of text (or one item), read one after the other."""
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        more = len((row["t"] or "").encode())
        if ids and size + more > pass_bytes:
            yield Benchmark(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += more
    yield Benchmark(ids, texts, window)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _scanner(bench, text: int, before: int | None, names: list[str], arrow_out: list[str]):
    """A mapInArrow function: passes ``names`` through and adds the findings (merged with those of ``before``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = bench.value
        for block in blocks(batches, text, SHARD_BYTES):
            shard = Shard(block.column(text), b.deepest)
            found = shard.findings(b)
            words = np.diff(shard.found.first)
            earlier = block.column(before).to_pylist() if before is not None else [None] * block.num_rows
            items, spans, hits, longest = [], [], [], []
            for (ids, begin, end), old in zip(found, earlier, strict=True):
                if old is not None and (old["items"] or old["spans"]):
                    ids = sorted({*ids, *old["items"]})
                    begin = np.concatenate([begin, np.array([s["start"] for s in old["spans"]], np.int64)])
                    end = np.concatenate([end, np.array([s["stop"] for s in old["spans"]], np.int64)])
                begin, end = _merge(begin, end)
                items.append(list(ids))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(begin, end, strict=True)])
                hits.append(int((end - begin).sum()))
                longest.append(int((end - begin).max(initial=0)))
            result = pa.StructArray.from_arrays(
                [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(longest, pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(spans, _FOUND)],
                ["n_words", "n_hit", "longest", "items", "spans"])
            kept = [block.column(names.index(c)) for c in arrow_out[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, result], names=arrow_out)

    return run


def _findings(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The columns of ``docs`` as c0, c1... and one struct column ``found`` (``SCAN_TYPE``), row by row."""
    spark = docs.sparkSession
    ship_package(spark)
    columns = docs.columns
    # Positional names inside: an input column may have any name, even that of a finding.
    inner = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = columns.index(text)
    passed = False
    for part in _passes(benchmark, item_id, item_text, window, pass_bytes):
        if passed:
            inner = cut_lineage(inner)
        names = inner.columns
        out = [f"c{i}" for i in range(len(columns))] + ["found"]
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields[: len(columns)])
        run = _scanner(spark.sparkContext.broadcast(part), at, len(columns) if passed else None, names, out)
        inner = inner.mapInArrow(run, f"{kind}, found struct<{SCAN_TYPE}>")
        passed = True
    return inner


def contaminated(n_hit, n_words, ratio: int = RATIO):
    return (n_hit > 0) & (F.lit(ratio) * n_hit >= n_words)


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: id, word and hit counts, longest hit run, item ids and hit spans (in words)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _findings(slim, benchmark, "text", **options).select(F.col("c0").alias("doc_id"), "found.*").withColumn(
        "contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", ratio: int = RATIO, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    marked = _findings(docs, benchmark, text, **options)
    return marked.where(~contaminated(F.col("found.n_hit"), F.col("found.n_words"), ratio)).drop("found").toDF(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For every benchmark suffix with a match: its longest verbatim match over all shards and one location.

    Columns: item_id (text), item_at (word offset of the suffix), length (words), doc_id, doc_at. Ties go
    to the smallest doc_id, then the smallest offset. ``doc_id`` must be an integer column.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = None
    for part in _passes(benchmark, item_id, item_text, WINDOW, pass_bytes):
        held = spark.sparkContext.broadcast(part)

        def run(batches, held=held):
            b: Benchmark = held.value
            for block in blocks(batches, 1, SHARD_BYTES):
                shard = Shard(block.column(1), b.deepest)
                longest, where, _, _ = shard.search(b)
                hit = np.flatnonzero(longest)
                doc = np.searchsorted(shard.starts, where[hit], side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.ids[i] for i in b.item[hit]], pa.string()), pa.array(b.offset[hit], pa.int64()),
                     pa.array(longest[hit]), block.column(0).take(pa.array(doc)), pa.array(where[hit] - shard.starts[doc])],
                    names=["item_id", "item_at", "length", "doc_id", "doc_at"])

        found = slim.mapInArrow(run, "item_id string, item_at long, length long, doc_id long, doc_at long")
        parts = found if parts is None else parts.unionByName(found)
    best = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_at")).alias("b")
    return parts.groupBy("item_id", "item_at").agg(best).select(
        "item_id", "item_at", (-F.col("b.l")).alias("length"), "b.doc_id", "b.doc_at")
