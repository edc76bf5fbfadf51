"""Conversation repair: alignments against a search over all edits, odd inputs, the repaired turns."""

import hashlib
import itertools
import random

import pytest

from medledger.llm import conversation_repair as R


def best(rows):
    """Cost and least audit by relaxing every edit over (rows taken, grammar state), insertions until nothing changes."""
    live = {"0": (0, "")}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way
            return True
        return False

    def insert(to):
        while any([put(to, after, (to[b][0] + 5, to[b][1] + "I")) for b, after in (("0", "u"), ("s", "u"), ("a", "u"), ("u", "a")) if b in to]):
            pass

    for row in rows:
        insert(live)
        after = {}
        for state, (cost, said) in live.items():
            put(after, state, (cost + 2, said + "D"))
            if row == "-":
                continue
            late = 5 if row.isupper() else 0
            for role in {"0": "su", "s": "u", "u": "a", "a": "u"}[state]:
                if row.lower() == role:
                    put(after, role, (cost + late, said + "K"))
                elif role != "s":
                    put(after, role, (cost + late + 1, said + "R"))
        live = after
    insert(live)
    return min(live[s] for s in "0a" if s in live)


def aligned(rows):
    one = R.Aligner()
    for r in rows:
        one.add(r)
    return one.close()


def test_every_short_conversation():
    for n in range(5):
        for rows in itertools.product("suaxUS-", repeat=n):
            assert aligned(rows) == best(rows), rows


@pytest.mark.parametrize("letters", ["sua", "u", "x", "ua", "suaxSUAX-", "uuuaS-", "U", "-"])
def test_long_conversations(letters):
    rng = random.Random(letters)
    for _ in range(25):
        rows = [rng.choice(letters) for _ in range(rng.randrange(90))]
        assert aligned(rows) == best(rows), rows


def expected(turns):
    """The contract's counts, audit and digest of one conversation's (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, letters, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        spoken = text.strip(R.WHITE)
        fault = 0 if not spoken else 1 if (role, text) in seen else 2 if spoken[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        letters.append("-" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    cost, audit = best(letters)
    out, at, last = [], iter(rows), ""
    for edit in audit:
        row = None if edit == "I" else next(at)
        if edit != "D":
            role = row[1] if edit == "K" else "assistant" if last == "u" else "user"
            out.append(f"{role}:{row[2] if row else ''}")
            last = role[:1]
    said = "\n".join(out)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()), out


CASES = {
    1: [(0, "user", "Hi."), (1, "assistant", "Yes.")],
    2: [(None, "user", "a."), (None, "user", "a."), (3, None, None), (3, "assistant", "b."), (9, "assistant", "c")],
    3: [(1, "", "odd."), (2, "tool", "t."), (3, "system", "s.")],
    4: [(k % 40, random.Random(k).choice(["user", "assistant", "system"]), f"text {k % 61}{'.' * (k % 7)}") for k in range(400)],
    5: [(0, "user", ""), (0, "user", "")],
    6: [(0, "user", "long words " * 50_000 + "."), (1, "assistant", "漢字。")],
    None: [(0, "assistant", "x.")],
}


def test_conversations_with_odd_rows(spark):
    rows = [(c, t, r, x, "clash") for c, turns in CASES.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(5)
    names = spark.createDataFrame([(1,), (7,), (None,)], "conv_id long")
    audits = R.audit(df, names)
    got = {r["conv_id"]: tuple(r)[1:] for r in R.digest(df, audits).collect()}
    want = {c: expected(t)[0] for c, t in CASES.items()} | {7: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}
    assert got == want
    turns = {}
    for r in R.repair(df, audits).orderBy("conv_id", "pos").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["pos"] == len(turns[r["conv_id"]]) - 1 and r["edit"] in "IKR"
    assert turns == {c: out for c, t in CASES.items() if (out := expected(t)[1])}


def test_repeated_rows_and_empty_table(spark):
    many = spark.range(50_000).selectExpr("'c' AS conv_id", "0L AS turn", "'user' AS role", "'same text.' AS text")
    row = R.digest(many, R.audit(many)).first()
    assert row["duplicate"] == 49_999 and row["cost"] == 2 * 50_000 and row["audit"] == "D" * 50_000 and row["illegal"] == 49_999
    none = many.where("turn > 5")
    assert R.digest(none, R.audit(none)).count() == R.repair(none, R.audit(none)).count() == 0
