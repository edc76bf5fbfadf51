"""Repair of conversation structure by Wagner-Fischer alignment with an alternating grammar.

The role initials of a repaired conversation are ``(s?(ua)+)?``. Turns may be kept (0), given the role user or
assistant (1) or deleted (2; a must for blank and repeated turns), and an empty turn of user or assistant may be
inserted anywhere (5); a truncated turn that is not deleted adds 5. For every feasible length of the grammar's
string (a length and the states at both ends fix it) the turns are aligned with that string. The cells of an
alignment are cut to Ukkonen's band: what the shifts of a cell cost at least must not exceed the incumbent, the
best cost of the lengths before. Equal costs are decided by the backtraced audits (D, I, K, R for deleted,
inserted, kept, given a role), of which the ASCII-least wins.

A long conversation is aligned in chunks of ``CHUNK`` turns between every pair of grammar states at their ends;
of each state the cheapest audit is carried on. That is exact: a state's future depends on nothing else, and no
two audits of the same turns and equal cost are prefixes of each other (an insertion costs), so the least of
joined audits is the join of the least.

Two passes. ``audit`` shuffles slim rows (no texts): equal rows of a turn are counted before the shuffle, a
conversation's rows pass in order through a task that holds a chunk and at most four audits. ``repair`` and
``digest`` send the texts and the audits through the same order, one row in hand at a time, so a conversation
with a third of all rows takes long in its task (a digest of a text is a sequence by nature) but no memory
beyond its audit, a letter a turn.

Defined cases: a null role or text is one space; a null ``turn`` comes first; rows of one turn are ordered by
role, then by the MD5 of the text; rows with a null conversation id are one conversation; an empty role has an
empty initial, which fits no place of the grammar. Only the named columns are read, so others may have any name.
Empty texts are blank. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medledger.llm.text import ship_package

CHUNK = 16
RETAG, DROP, ADD, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, behind the system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = "0sua"
STATES = START + SYSTEM + USER + ASSISTANT
ROLES = {"u": "user", "a": "assistant"}
_FAR = 1 << 60

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def target(before: str, after: str, size: int) -> str | None:
    """The grammar's only string of this length between two states, or None."""
    if not size:
        return "" if before == after else None
    if before == START:
        if after == START:
            return None
        if after == SYSTEM:
            return "s" if size == 1 else None
        lead = size % 2 == (after == ASSISTANT)  # an odd string that ends in a, or an even one that ends in u
        said = ("s" if lead else "") + ("ua" * size)[: size - lead]
        return said if said[-1] == after else None
    said = ("au" if before == USER else "ua") * size
    return said[:size] if said[size - 1] == after else None


def _shift(d: int) -> int:
    """The least cost of d more insertions than deletions (less, if negative)."""
    return ADD * d if d > 0 else -DROP * d


def _align(rows: str, want: str, limit: int) -> tuple[int, str] | None:
    """The cheapest alignment of rows with a string, of a cost of at most ``limit``, and its least audit.

    A row is the initial of its role (x: another), upper case if truncated, or ``-`` if it must be deleted.
    """
    n, m = len(rows), len(want)
    near = [d for d in range(-n, m + 1) if _shift(d) + _shift(m - n - d) <= limit]
    if not near:
        return None
    low, high = near[0], near[-1]
    cost = [[_FAR] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        here, below = cost[i], cost[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                here[j] = 0
                continue
            best = below[j] + DROP if i < n else _FAR
            if j < m:
                if want[j] != "s":
                    best = min(best, here[j + 1] + ADD)
                if i < n:
                    best = min(best, below[j + 1] + _match(rows[i], want[j]))
            here[j] = best
    if cost[0][0] > limit:
        return None
    out, i, j = [], 0, 0
    while i < n or j < m:
        here = cost[i][j]
        if i < n and here == cost[i + 1][j] + DROP:
            out.append("D")
            i += 1
        elif j < m and want[j] != "s" and here == cost[i][j + 1] + ADD:
            out.append("I")
            j += 1
        else:
            out.append("K" if rows[i].lower() == want[j] else "R")
            i, j = i + 1, j + 1
    return cost[0][0], "".join(out)


def _match(row: str, role: str) -> int:
    if row == "-":
        return _FAR
    less = TRUNCATED if row.isupper() else 0
    return less if row.lower() == role else _FAR if role == "s" else RETAG + less


@lru_cache(1 << 16)
def align(rows: str, before: str, after: str) -> tuple[int, str] | None:
    """The cheapest edits of some rows between two grammar states, over all feasible lengths; None: there are none."""
    n = len(rows)
    best, limit = None, DROP * n + 3 * ADD  # all deleted, the shortest string inserted (at most three turns)
    sizes = sorted(range(n + limit // ADD + 1), key=lambda m: (_shift(m - n), m))
    for size in sizes:
        if _shift(size - n) > limit:
            break
        want = target(before, after, size)
        found = None if want is None else _align(rows, want, limit)
        if found is not None:
            best = found if best is None else min(best, found)
            limit = best[0]
    return best


class Aligner:
    """Takes the rows of a conversation in order; ``close`` gives the cost and the audit."""

    def __init__(self):
        self.rows = ""
        self.said: list[str] = []  # what all live audits have in common
        self.live = {START: (0, "")}

    def add(self, rows: str) -> None:
        self.rows += rows
        while len(self.rows) > CHUNK:
            self._step(self.rows[:CHUNK], STATES)
            self.rows = self.rows[CHUNK:]

    def _step(self, rows: str, ends: str) -> None:
        live = {}
        for after in ends:
            found = [(cost + more[0], audit + more[1]) for before, (cost, audit) in self.live.items()
                     if (more := align(rows, before, after)) is not None]
            if found:
                live[after] = min(found)
        # States that cannot win: whatever follows them follows an assistant turn (a user turn and an inserted one) for as
        # much, and what begins with the system turn for a deletion more.
        at = min(live.get(ASSISTANT, (_FAR,))[0], live.get(USER, (_FAR,))[0] + ADD)
        if live.get(START, (0,))[0] > at + DROP and ends == STATES:
            del live[START]
        if live.get(SYSTEM, (0,))[0] > at:
            del live[SYSTEM]
        audits = [a for _, a in live.values()]
        first, last = min(audits), max(audits)
        common = next((k for k, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))  # noqa: B905
        self.said.append(first[:common])
        self.live = {state: (cost, audit[common:]) for state, (cost, audit) in live.items()}

    def close(self) -> tuple[int, str]:
        self._step(self.rows, START + ASSISTANT)
        cost, rest = min(self.live.values())
        return cost, "".join(self.said) + rest


def _ordered(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    told = F.coalesce(F.col(text), F.lit(" "))
    return turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.md5(told).alias("mark"), told.alias("text"))


def _symbol(first: Column) -> Column:
    """A row's letter for ``align``."""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("blank") | ~first, "-").when(F.col("cut"), F.upper(letter)).otherwise(letter)


def audit(turns: DataFrame, conversations: DataFrame | None = None, conversation: str = "conv_id", turn: str = "turn",
          role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost (long) and audit.

    ``conversations`` names ids that shall have a row even if no turn of theirs is left.
    """
    ship_package(turns.sparkSession)
    spoken = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = _ordered(turns, conversation, turn, role, text).withColumns(
        {"blank": spoken == "", "cut": ~F.substring(spoken, -1, 1).isin(".", "!", "?")})
    slim = rows.groupBy("conv", "turn", "role", "mark").agg(
        F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    if conversations is not None:
        names = conversations.select(F.col(conversation).alias("conv")).distinct()
        slim = slim.unionByName(names.withColumns({"n": F.lit(0).cast("long")}), allowMissingColumns=True)
    # The window and the sort keep the partitioning by conversation.
    nth = F.row_number().over(Window.partitionBy("conv", "role", "mark").orderBy("turn"))
    slim = slim.repartition("conv").withColumn("nth", nth)
    first = F.col("nth") == 1
    lines = slim.sortWithinPartitions("conv", "turn", "role", "mark").select(
        "conv", "turn", "n", F.substring("role", 1, 1).alias("initial"), _symbol(first).alias("symbol"), "blank", first.alias("first"), "cut")
    kind = slim.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        schema, now = None, None
        for batch in batches:
            schema = batch.schema.field(0).type
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        held.append(now.close())
                    now = _Conversation(conv)
                now.add(*row)
            if len(held) > 4096:
                yield _batch(held, schema)
                held = []
        if now is not None:
            yield _batch([*held, now.close()], schema)

    out = lines.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")
    return out.withColumnRenamed("conv", conversation)


def _batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, *[pa.int64()] * len(COUNTS), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["conv", *COUNTS, "audit"])


class _Conversation:
    """Counts the faults of a conversation while its rows pass."""

    def __init__(self, conv):
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.aligner = Aligner()

    def add(self, turn, n, initial, symbol, blank, first, cut) -> None:
        if not n:
            return  # names the conversation only
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += 1
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last = initial
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and cut
        self.aligner.add(symbol)
        for at in range(1, n, 1 << 16):
            self.aligner.add("-" * min(n - at, 1 << 16))

    def close(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        cost, said = self.aligner.close()
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, said


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Carries out audits. Rows are (conv, audit or None, role, text); an audit comes before its conversation's turns.

    Yields (conv, edit, role, text) of every repaired turn, and (conv, None, None, None) behind a conversation.
    """
    conv, said, at, last = None, None, 0, ""

    def inserted():
        nonlocal at, last
        while at < len(said) and said[at] == "I":
            at, last = at + 1, "a" if last == "u" else "u"
            yield conv, "I", ROLES[last], ""

    for row in rows:
        if row[1] is not None:
            if said is not None:
                yield from inserted()
                yield conv, None, None, None
            conv, said, at, last = row[0], row[1], 0, ""
            continue
        yield from inserted()
        edit, role = said[at], row[2]
        at += 1
        if edit != "D":
            last = "a" if last == "u" else "s" if edit == "K" and role[:1] == "s" else "u"
            yield conv, edit, role if edit == "K" else ROLES[last], row[3]
    if said is not None:
        yield from inserted()
        yield conv, None, None, None


def _stream(turns: DataFrame, audits: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The texts in order, each conversation's audit before them."""
    rows = _ordered(turns, conversation, turn, role, text)
    heads = audits.select(F.col(conversation).alias("conv"), *COUNTS, "audit")
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), "turn", "role", "mark").select(
        "conv", "audit", "role", "text", *COUNTS)


def repair(turns: DataFrame, audits: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """The repaired turns: conversation id, position from 0 (long), role, text, edit (I, K or R)."""
    stream = _stream(turns, audits, conversation, turn, role, text)
    kind = stream.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = []

        def rows():
            for batch in batches:
                schema[:] = [batch.schema.field(0).type]
                for piece in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                    yield from zip(*[piece.column(i).to_pylist() for i in range(4)], strict=True)

        held, size, place = [], 0, 0
        for conv, edit, who, said in _edited(rows()):
            if edit is None:
                place = 0
                continue
            held.append((conv, place, who, said, edit))
            place, size = place + 1, size + len(said) + 64
            if size > 1 << 20:
                yield _turns(held, schema[0])
                held, size = [], 0
        if held:
            yield _turns(held, schema[0])

    out = stream.mapInArrow(run, f"conv {kind}, pos long, role string, text string, edit string")
    return out.withColumnRenamed("conv", conversation)


def _turns(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = (conv, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["conv", "pos", "role", "text", "edit"])


def digest(turns: DataFrame, audits: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """``audits`` with ``repaired_sha256``: the lower-case hex digest of the repaired turns' ``role:text``, joined by newlines."""
    stream = _stream(turns, audits, conversation, turn, role, text)
    kind = stream.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, heads = [], []  # audits whose turns have not all passed yet, or not been given out

        def rows():
            for batch in batches:
                schema[:] = [batch.schema.field(0).type]
                for piece in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                    columns = [piece.column(i).to_pylist() for i in range(4 + len(COUNTS))]
                    for row in zip(*columns, strict=True):
                        if row[1] is not None:
                            heads.append((row[0], *row[4:], row[1]))
                        yield row[:4]

        done, made, gap = [], hashlib.sha256(), b""
        for _, edit, who, said in _edited(rows()):
            if edit is None:
                done.append((*heads.pop(0), made.hexdigest()))
                made, gap = hashlib.sha256(), b""
                if len(done) > 1024:
                    yield _digests(done, schema[0])
                    done = []
            else:
                made.update(gap + f"{who}:{said}".encode())
                gap = b"\n"
        if done:
            yield _digests(done, schema[0])

    out = stream.mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conversation)


def _digests(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["conv", *COUNTS, "audit", "repaired_sha256"])
