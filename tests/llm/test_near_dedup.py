import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from medledger.llm import near_dedup as N
from medledger.llm.text import mix
from tests.llm.cases import none, odd, words


def sets(text):
    """Shingles and how often each is there."""
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs):
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = {i: sets(t) for i, t in docs}
    told = dict(docs)
    for i, _ in docs:
        for j, _ in docs:
            if i < j:
                both = (s[i] & s[j]).total()
                if (not s[i] and not s[j] and (told[i] or "") == (told[j] or "")) or (both and both * 5 >= 4 * (s[i].total() + s[j].total() - both)):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: find(i) for i, _ in docs}


def test_shingles_equal_brute_force():
    texts = ["a b c d e f a b c d e f a", "x", "", None, "a b c d", "é é é é é é é"]
    _, first, times = N.shingles(pa.array(texts))
    assert np.diff(first).tolist() == [len(sets(t)) for t in texts]
    assert [sorted(times[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)] == [sorted(sets(t).values()) for t in texts]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = {i: float(rng.integers(1, 9)) for i in range(60)}
    b = {i: float(rng.choice([a.get(i, 3.0), 2.5, 0.7])) for i in range(20, 90)}
    element = mix(np.array([*a, *b], np.uint64))
    got = N.signatures(element, np.array([0, len(a), len(a) + len(b)]), 4096, np.array([*a.values(), *b.values()]))
    keys = {*a, *b}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs((got[0] == got[1]).mean() - true) < 0.04


def test_signatures_are_the_earliest_of_all_darts(monkeypatch):
    """Against all darts of four times the rank, thrown at once; whatever rows are signed together."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 0, 7, 300, 40, 3000]
    first = np.concatenate([[0], np.cumsum(sizes)])
    element = mix(np.arange(first[-1], dtype=np.uint64))
    weight = rng.choice([1.0, 1.0, 1.0, 2.0, 3.0, 0.4, 11.5, 100.0], first[-1])
    got = N.signatures(element, first, 64, weight)
    monkeypatch.setattr(N, "DARTS", 1)
    assert (N.signatures(element, first, 64, weight) == got).all()
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        best = [(np.inf, 0)] * 64
        limit = np.full(b - a, 4 * 64 * (np.log(64) + 2) / max(weight[a:b].sum(), 0.1))
        for _, ranks, darts in N._darts(element[a:b], weight[a:b], np.zeros(b - a), limit):
            for rank, dart in zip(ranks.tolist(), darts.tolist(), strict=True):
                best[(dart >> 32) * 64 >> 32] = min(best[(dart >> 32) * 64 >> 32], (rank, dart))
        assert got[i].tolist() == [d for _, d in best]


def test_cells_hold_darts_by_area():
    """Mean and variance of the number of darts of a region are its area."""
    element = mix(np.arange(20000, dtype=np.uint64))
    for weight, limit in ((1.0, 3.0), (2.5, 2.0), (0.4, 5.0)):
        count = np.zeros(len(element))
        for index, rank, _ in N._darts(element, np.full(len(element), weight), np.zeros(len(element)), np.full(len(element), limit)):
            count += np.bincount(index[rank < limit], minlength=len(element))
        assert abs(count.mean() / (weight * limit) - 1) < 0.02 and abs(count.var() / (weight * limit) - 1) < 0.05


def test_classes_equal_brute_force(spark):
    """A large group of near copies around a centre, chains, exact copies, and a passage that many share."""
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 400)}"
    base = [word() for _ in range(80)]
    docs = []
    for _ in range(120):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = word()
        docs.append(t)
    chain = [word() for _ in range(60)]
    for _ in range(12):
        docs.append(list(chain))
        chain[r.randrange(60)] = word()
    passage = [word() for _ in range(20)]
    docs += [[word() for _ in range(30)] + passage for _ in range(40)] + [["only", "three", "words"]] * 3 + [[]] * 2
    docs += [base + line * k for line in [[word() for _ in range(8)]] for k in range(1, 24)]  # as sets nearly equal, as weighted sets not
    docs = [(i * 3, " ".join(t)) for i, t in enumerate(docs)]
    r.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in N.classes(frame).collect()}
    assert got == brute(docs)
    kept = [x["doc_id"] for x in N.dedup(frame).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = N.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["root"] for x in got} == want and len(got) == len(want)


def test_odd_inputs(spark):
    got = Counter((x["doc_id"], x["class_id"]) for x in N.classes(odd(spark)).collect())
    assert got == Counter({(None, None): 1, (1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 4): 2, (5, 4): 1, (6, 6): 1, (7, 6): 1, (8, 8): 1})
    kept = N.dedup(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "3", "4", "6", "8", "None"]
    assert N.classes(none(spark)).count() == 0 and N.dedup(none(spark)).count() == 0


def test_dedup_keeps_one_row_of_each_group(spark):
    """Repeated ids with different texts, ids whose smaller half is a copy, and rows without an id."""
    x, w, z, y = ([f"{c}{i}" for i in range(60)] for c in "xwzy")
    near = [*x[:-1], "other"]
    rows = [(1, x), (5, near), (5, w), (7, z), (7, z), (7, y), (None, y), (None, near), (None, ["q"] * 3), (None, ["q"] * 3), (None, w[::-1]), (9, [])]
    rows += [(7, [f"own{i}", *w[:9], f"own{i}"]) for i in range(30)]
    frame = spark.createDataFrame([(i, " ".join(t), n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(5)
    got = Counter((r["doc_id"], r["text"]) for r in N.dedup(frame).collect())
    want = [(1, x), (5, w), (7, z), (7, y), (None, ["q"] * 3), (None, w[::-1]), (9, []), *rows[12:]]
    assert got == Counter((i, " ".join(t)) for i, t in want)
