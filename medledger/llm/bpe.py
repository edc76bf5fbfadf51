"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut into pieces as the usual pattern does (contractions, an optional space before letters,
numbers or other signs, runs of white space), but without a regular expression: an array of code-point
classes, looked up in a table, is turned into transition functions of a small automaton. Function
composition is associative, so an inclusive scan over blocks of functions gives the state at every code
point, and with it all piece boundaries, in a fixed number of array operations.

Each distinct piece of a block is merged once, by rank, and kept in a bounded per-worker cache (sorted hashes
that are looked up as an array). Token ids of a block are gathered from the distinct pieces; byte offsets of the tokens are kept, and decoding
gathers token bytes by them. Every encoded block is decoded and compared with its bytes, so a collision
of piece hashes (64 bits) cannot pass: such a block is encoded again piece by piece.

The class table is read off the library whose pattern is meant (which Unicode version it knows), once,
on the driver. Rank files are read on the driver and broadcast; their path is a parameter. Nothing is
shuffled; texts are worked on in Arrow blocks of about ``BLOCK_BYTES``, a longer text alone.

Defined cases: a null text is an empty text and has no tokens; bytes that are not UTF-8 count as U+FFFD;
repeated rows are encoded row by row; an empty table gives an empty result. ``encode`` keeps all input
columns and adds its own behind them, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from medledger.llm.text import AS_IS, blocks, ship_package, slice_hashes, text_bytes

BLOCK_BYTES = 1 << 20
#: Pieces whose ids a worker keeps (some 40 bytes each); beyond that, the half not used for longest goes.
CACHE_PIECES = 1_000_000

# Code-point classes.
OTHER, LETTER, NUMBER, WHITE, SPACE, QUOTE = range(6)
# Symbols of the automaton: the first three are the classes; QUOTE1 and QUOTE2 begin a contraction of one
# or two letters; SPACE_LAST is U+0020 before a sign, WHITE_LAST other white space before a sign, and
# WHITE_MORE white space before more of it or before the end. FIRST marks a text's first code point.
QUOTE1, QUOTE2, SPACE_LAST, WHITE_LAST, WHITE_MORE = range(3, 8)
FIRST = 8
# States: what the last code point belongs to. ENDED: the next one begins a piece.
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_LETTER, TWO_LETTERS = range(8)
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the code point begins a piece."""
    if symbol == LETTER:
        if state in (TWO_LETTERS, ONE_LETTER):
            return (ONE_LETTER if state == TWO_LETTERS else ENDED), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if symbol in (OTHER, QUOTE1, QUOTE2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, QUOTE1: ONE_LETTER, QUOTE2: TWO_LETTERS}[symbol], True
    if symbol == WHITE_MORE:
        return IN_WHITE, state != IN_WHITE
    return (AFTER_SPACE if symbol == SPACE_LAST else ENDED), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol; composition table; state table (function, state); begin table (state, symbol)."""
    single = [tuple(_step(s, c)[0] for s in range(STATES)) for c in range(FIRST)]
    single += [(f[ENDED],) * STATES for f in single]  # at a text's start the past does not matter
    functions = list(dict.fromkeys([tuple(range(STATES)), *single]))
    at = 0
    while at < len(functions):
        for g in dict.fromkeys(single):
            made = tuple(g[s] for s in functions[at])
            if made not in functions:
                functions.append(made)
        at += 1
    index = {f: i for i, f in enumerate(functions)}
    compose = np.array([[index[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    begins = np.array([[_step(s, c % FIRST)[1] or c >= FIRST for c in range(2 * FIRST)] for s in range(STATES)])
    return np.array([index[f] for f in single], np.uint8), compose, np.array(functions, np.uint8), begins


FUNCTION, COMPOSE, APPLY, BEGINS = _monoid()
_COUNT = len(APPLY)


def scan(functions: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive scan of function ids under composition."""
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], out[i]]
        return out
    count = -(-n // block)
    grid = np.zeros(count * block, np.uint8)  # function 0 is the identity
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(count, block).T)
    flat = COMPOSE.ravel()
    for j in range(1, block):
        grid[j] = flat[grid[j - 1].astype(np.int32) * _COUNT + grid[j]]
    before = np.concatenate([[0], scan(grid[-1].copy(), block)[:-1]])
    return flat[before[None, :].astype(np.int32) * _COUNT + grid].T.ravel()[:n]


def class_table(letters: str, numbers: str, whites: str) -> np.ndarray:
    """Classes of all code points, given which are letters, numbers and white space."""
    table = np.zeros(0x110000, np.uint8)
    for kind, members in ((LETTER, letters), (NUMBER, numbers), (WHITE, whites)):
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


def every_code_point() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def tiktoken_classes() -> np.ndarray:
    """The classes as the tiktoken library knows them: what its patterns match of all code points."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    text = every_code_point()

    def matched(pattern: str) -> str:
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return own.decode(own.encode_ordinary(text))

    return class_table(matched(r"\p{L}"), matched(r"\p{N}"), matched(r"\s"))


def utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of valid UTF-8; otherwise of the bytes with faults replaced. (data, offsets, code points)."""
    try:
        return data, offsets, np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data = np.frombuffer(b"".join(rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return data, offsets, np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)


def piece_starts(data: np.ndarray, offsets: np.ndarray, points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where pieces begin; a text's first code point always begins one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80) if n < len(data) else None  # None: every byte is a code point
    filled = np.diff(offsets) > 0
    first = offsets[:-1][filled] if place is None else np.searchsorted(place, offsets[:-1][filled])
    last = np.concatenate([first[1:], [n]]) - 1
    kind = classes[points]
    # A code point of the class of the one before it changes nothing, unless it is white or among the three behind a
    # quote: only the others are passed through the automaton.
    keep = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=keep[1:])
    keep |= kind >= WHITE
    keep[first] = True
    quotes = np.flatnonzero(kind == QUOTE)
    for k in (1, 2, 3):
        keep[np.minimum(quotes + k, n - 1)] = True
    at = np.flatnonzero(keep)
    here, ahead = kind[at], kind[np.minimum(at + 1, n - 1)]
    symbol = np.minimum(here, WHITE).astype(np.uint8)
    before_sign = (ahead < WHITE) | (ahead == QUOTE)
    ends = np.searchsorted(at, last)
    before_sign[ends[at[np.minimum(ends, len(at) - 1)] == last]] = False
    white = (here == WHITE) | (here == SPACE)
    symbol[white] = WHITE_MORE
    symbol[white & before_sign] = WHITE_LAST
    symbol[(here == SPACE) & before_sign] = SPACE_LAST
    if len(quotes):
        end = last[np.searchsorted(last, quotes)]
        one = np.where(quotes + 1 <= end, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= end, points[np.minimum(quotes + 2, n - 1)], 0)
        mark = np.searchsorted(at, quotes)
        symbol[mark] = OTHER
        symbol[mark[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = (one.astype(np.int64) << 21) | two
        symbol[mark[np.isin(pair, [(ord(a) << 21) | ord(b) for a, b in ("re", "ve", "ll")])]] = QUOTE2
    symbol[np.searchsorted(at, first)] += FIRST
    state = APPLY[scan(FUNCTION[symbol]), ENDED]
    before = np.concatenate([[ENDED], state[:-1]])
    begin = at[BEGINS[before, symbol]]
    return begin if place is None else place[begin]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked neighbours, leftmost first, until none is known: with a heap, for a long piece."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
    back = list(range(-1, n))  # where the part before this one begins
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < n:
            stop = end[end[at]]
            rank = ranks.get(piece[at:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, at, stop))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = end[at]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[at], end[middle] = stop, 0
        back[stop] = at
        offer(at)
        offer(back[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class PairMerger:
    """Merges many pieces at once: in every round, the lowest-ranked pair of each piece, leftmost first."""

    BITS = 21
    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        # Every split of a token into two tokens, in an open-addressing table of pair keys.
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        while len(pairs) * 2 > 1 << self.BITS:
            self.BITS += 1
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.merged = np.full(1 << self.BITS, self.NONE, np.int32)
        key = np.fromiter(pairs.keys(), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            _, lead = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[lead]
            self.keys[at[put]], self.merged[at[put]] = key[put], made[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, made, at = key[rest], made[rest], (at[rest] + ~free[rest]) & ((1 << self.BITS) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that each pair of ids makes, or NONE."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.merged[at], self.NONE)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.BITS) - 1)
            got = self.keys[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        work = []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > 48:
                out[i] = _merge_long(p, self.ranks)
            else:
                work.append(i)
        for at in range(0, len(work), 1 << 16):
            part = work[at : at + (1 << 16)]
            for i, ids in zip(part, self._merge([pieces[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        symbol = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = np.full(len(symbol), self.NONE, np.int32)
            same = np.flatnonzero(owner[1:] == owner[:-1])
            rank[same] = self.rank(symbol[same], symbol[same + 1])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.concatenate([first, [len(owner)]]))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            over = best == self.NONE
            if over.any():
                done.append((owner[over], symbol[over]))
            at = np.flatnonzero((rank == best) & ~over)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
            symbol[at] = rank[at]
            keep = ~over
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate([x for _, x in done])[order].tolist() if done else []
        cut = np.searchsorted(owners[order], np.arange(len(pieces) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class PieceCache:
    """Ids of known pieces by their hashes: sorted hashes, and where the ids of each stand in one array."""

    def __init__(self):
        self.keys, self.begin, self.size, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.flat, self.end, self.turn = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of some hashes, -1 for unknown ones."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        at[~known] = -1
        self.turn += 1
        self.used[at[known]] = self.turn
        return at

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keep the ids of new pieces; returns where they begin."""
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.end : self.end + len(ids)] = ids
        begin = self.end + np.cumsum(size, dtype=np.int64) - size
        self.end += len(ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.begin = np.insert(self.keys, at, keys[order]), np.insert(self.begin, at, begin[order])
        self.size, self.used = np.insert(self.size, at, size[order]), np.insert(self.used, at, self.turn)
        return begin

    def trim(self, most: int) -> None:
        """Forget the half that has not been used for longest, if there are more than so many."""
        if len(self.keys) <= most:
            return
        keep = np.sort(np.argsort(-self.used, kind="stable")[: most // 2])
        flat = gather(self.flat, self.begin[keep], self.size[keep])
        self.keys, self.size, self.used = self.keys[keep], self.size[keep], self.used[keep]
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        self.flat, self.end = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), len(flat)


class Codec:
    """Encodes and decodes blocks of texts.

    ``encode_pieces`` gives the ids of some distinct pieces, one after the other, and how many each has. Texts that
    hold one of ``special`` are given whole to ``encode_whole``, which gives their ids.
    """

    def __init__(self, classes: np.ndarray, tokens: list[bytes], encode_pieces: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
                 special: Sequence[bytes] = (), encode_whole: Callable[[str], list[int]] | None = None):
        self.classes, self.encode_pieces, self.special, self.encode_whole = classes, encode_pieces, special, encode_whole
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        decimal = [b"%d," % i for i in range(len(tokens))]
        self.decimal_size = np.array([len(d) for d in decimal], np.int32)
        self.decimal_at = np.concatenate([[0], np.cumsum(self.decimal_size)[:-1]]).astype(np.int32)
        self.decimal = np.frombuffer(b"".join(decimal), np.uint8)
        self.cache = PieceCache()

    @classmethod
    def of_ranks(cls, classes: np.ndarray, ranks: dict[bytes, int]) -> Codec:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        merge = PairMerger(ranks)

        def pieces(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            each = merge(raw)
            size = np.fromiter(map(len, each), np.int32, len(each))
            return np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(size.sum())), size

        return cls(classes, tokens, pieces)

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        codes = pa.array(slice_hashes(data, starts, [ends], AS_IS)[0]).dictionary_encode()
        inverse, keys = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_numpy()
        example = np.zeros(len(keys), np.int64)
        example[inverse[::-1]] = np.arange(len(inverse))[::-1]
        self.cache.trim(CACHE_PIECES)
        at = self.cache.find(keys)
        new = np.flatnonzero(at < 0)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        old = np.flatnonzero(at >= 0)
        begin[old], size[old] = self.cache.begin[at[old]], self.cache.size[at[old]]
        if len(new):
            raw, place = data.tobytes(), example[new]
            ids, size[new] = self.encode_pieces([raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)])
            begin[new] = self.cache.add(keys[new], ids, size[new])
        return gather(self.cache.flat, begin[inverse], size[inverse]), size[inverse]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end, byte offset of each id in its text, UTF-8 bytes)."""
        data, offsets, points = utf8(*text_bytes(texts))
        starts = piece_starts(data, offsets, points, self.classes)
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        ids, size = self._ids(data, starts, ends)
        if not np.array_equal(self.decode(ids), data):
            raw = data.tobytes()
            ids, size = self.encode_pieces([raw[a:b] for a, b in zip(starts, ends, strict=True)])
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        cut = upto[np.searchsorted(starts, offsets)]
        ids, cut = self._whole(data, offsets, ids, cut)
        place = np.cumsum(self.size[ids], dtype=np.int64) - self.size[ids]
        return ids, cut, place - np.repeat(offsets[:-1], np.diff(cut)), data

    def _whole(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of texts that hold a special string replaced."""
        raw = data.tobytes() if self.special else b""
        if not any(s in raw for s in self.special):
            return ids, cut
        parts = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any(raw.find(s, a, b) >= 0 for s in self.special):
                parts[k] = np.array(self.encode_whole(raw[a:b].decode()), np.uint32)
        return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some ids."""
        return gather(self.bytes, self.at[ids], self.size[ids])

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, a comma after each."""
        return gather(self.decimal, self.decimal_at[ids], self.decimal_size[ids])


def gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices ``source[begin : begin + size]``, one after the other."""
    upto = np.cumsum(size, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    shift = (begin - (upto - size)).astype(np.int64 if total + len(source) > 2**31 - 1 else np.int32)
    where = np.repeat(shift, size)
    where += np.arange(total, dtype=where.dtype)
    return source[where]


_codecs: dict[str, Codec] = {}


class SharedCodec:
    """A broadcast of ranks and classes from which each Python worker makes its codec once."""

    def __init__(self, spark, path: str):
        ranks = read_ranks(path)
        self.key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        self.held = spark.sparkContext.broadcast((tiktoken_classes().tobytes(), ranks))

    def get(self) -> Codec:
        if self.key not in _codecs:
            classes, ranks = self.held.value
            _codecs[self.key] = Codec.of_ranks(np.frombuffer(classes, np.uint8), ranks)
        return _codecs[self.key]


def _over(docs: DataFrame, at: int, add: str, run: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns ``add`` (a DDL string) that ``run`` makes of each block, added row by row."""
    columns = docs.columns
    names = [a.split()[0] for a in add.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at, BLOCK_BYTES):
            made = run(block)
            yield pa.RecordBatch.from_arrays([*block.columns, *made], names=[f"c{i}" for i in range(len(columns))] + [f"d{i}" for i in range(len(made))])

    kept = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    new = [f"d{i} {a.split(maxsplit=1)[1]}" for i, a in enumerate(add.split(", "))]
    out = docs.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(work, ", ".join(kept + new))
    return out.toDF(*columns, *names)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``starts`` (array<int>: byte offset of each token) added."""
    ship_package(docs.sparkSession)
    shared, at = SharedCodec(docs.sparkSession, path), docs.columns.index(text)

    def run(block: pa.RecordBatch) -> list[pa.Array]:
        ids, cut, place, _ = shared.get().encode(block.column(at))
        cut = pa.array(cut, pa.int32())
        return [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (ids, place)]

    return _over(docs, at, "ids array<int>, starts array<int>", run)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary) added: the bytes of the ids. A null list of ids is an empty one."""
    spark = encoded.sparkSession
    ship_package(spark)
    shared, columns = SharedCodec(spark, path), encoded.columns
    at = columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.get()
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(at).to_pylist()]
            made = pa.array([codec.decode(x).tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[f"c{i}" for i in range(len(columns) + 1)])

    kind = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(encoded.schema.fields))
    out = encoded.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(work, f"{kind}, c{len(columns)} binary")
    return out.toDF(*columns, "decoded")


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: ``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` added.

    Digests are lower-case hex: of the decimal ids joined by commas, and of the decoded bytes. The token
    lists themselves never leave the worker.
    """
    ship_package(docs.sparkSession)
    shared, at = SharedCodec(docs.sparkSession, path), docs.columns.index(text)

    def run(block: pa.RecordBatch) -> list[pa.Array]:
        codec = shared.get()
        ids, cut, _, _ = codec.encode(block.column(at))
        decoded, decimal = codec.decode(ids).tobytes(), codec.decimals(ids).tobytes()
        ends = [np.concatenate([[0], np.cumsum(size[ids], dtype=np.int64)])[cut].tolist() for size in (codec.size, codec.decimal_size)]
        sha = lambda data, end, less: [hashlib.sha256(memoryview(data)[a : max(a, b - less)]).hexdigest() for a, b in zip(end[:-1], end[1:], strict=True)]
        return [pa.array(np.diff(cut), pa.int64()), pa.array(sha(decimal, ends[1], 1), pa.string()), pa.array(sha(decoded, ends[0], 0), pa.string())]

    return _over(docs, at, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)
