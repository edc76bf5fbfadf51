import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from medledger.llm import cover_tree as C


def brute(ids, rows, picked, k):
    out = {}
    for i in picked:
        order = sorted((-int(rows[i] @ rows[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])
        out[int(ids[i])] = [(j, -s) for s, j in order[:k]]
    return out


@pytest.mark.parametrize("centres,spread,equal", [(5, 0.05, 0), (40, 0.3, 200), (1, 1.0, 0)])
def test_search_equals_brute_force(centres, spread, equal):
    rng = np.random.default_rng(centres)
    middle = rng.normal(0, 1, (centres, 8))
    rows = np.floor(1024 * (middle[rng.integers(0, centres, 1500)] + rng.normal(0, spread, (1500, 8)))).astype(np.int64)
    rows[100 : 100 + equal] = rows[0]
    ids = rng.permutation(1500)
    asked = np.flatnonzero(ids % 4 == 0)
    q = C.Tree(ids[asked], rows[asked])
    best = C.Best(len(asked), 10)
    scored = sum(C.search(q, C.Tree(ids[a : a + 400], rows[a : a + 400]), best) for a in range(0, 1500, 400))
    want = brute(ids, rows, asked, 10)
    for i, name in enumerate(q.ids):
        assert list(zip(best.id[i].tolist(), best.score[i].tolist(), strict=True)) == want[int(name)]
    if centres > 1:
        assert scored < len(asked) * 1500  # something was pruned


def test_tree_covers():
    rng = np.random.default_rng(0)
    rows = rng.integers(-1000, 1000, (700, 5))
    t = C.Tree(np.arange(700), rows)
    assert sorted(t.ids) == list(range(700))
    for n in range(len(t.radius)):
        inside = t.rows[t.begin[n] : t.end[n]]
        assert np.linalg.norm(inside - t.centre[n], axis=1).max() <= t.radius[n] + 1e-6
        if t.child_end[n]:
            assert t.begin[t.child[n]] == t.begin[n] and t.end[t.child_end[n] - 1] == t.end[n]


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 2.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [1.0, None]),
            (7, []), (8, [-1.0]), (None, [9.0, 9.0]), (100, [0.0011, -0.0011, 3.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(x) for x in C.top_k(frame, F.col("vec_id") % 100 == 0, k=4, block=3, query_block=1).orderBy("query_id", "rank").collect()]
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in [
        (0, [1, 2]), (1, [1, 2]), (2, [1, 2]), (2, [0.5, 2]), (7, []), (8, [-1]), (100, [0.0011, -0.0011, 3])]]
    want = []
    for q in (0, 100):
        order = sorted((-sum(a * b for a, b in zip(dict(whole)[q], v, strict=False)), i) for i, v in whole if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order[:4])]
    assert got == want
    assert C.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert C.top_k(frame.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_repeated_ids_and_few_pivots(spark, monkeypatch):
    """A hot id (query and candidate), many blocks, ties: as the SQL of the query has it."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (6, 5))
    rows = [(int(rng.choice([100, 100, 7, *range(40, 900)])), (centres[rng.integers(6)] + rng.normal(0, 0.05, 5)).round(2).tolist()) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in C.top_k(frame, F.col("vec_id") % 100 == 0, block=64, query_block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    x = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        scores = x[ids == q] @ x[ids != q].T
        want = sorted((-int(s), int(i)) for line in scores for s, i in zip(line, ids[ids != q], strict=True))[:10]
        assert got.pop(q) == want
    assert not got


def test_blocks_out_of_reach_are_not_moved(spark):
    """On clustered vectors, most pairs of blocks are refused by their summaries."""
    rng = np.random.default_rng(2)
    centres = np.eye(8) * 50
    rows = [(k, (centres[k % 8] + rng.normal(0, 0.1, 8)).tolist()) for k in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    moved = []
    real = C._searcher
    C._searcher = lambda k, seeding: moved.append(seeding) or real(k, seeding)
    try:
        out = C.top_k(frame, F.col("vec_id") % 100 == 0, block=128, query_block=64)
    finally:
        C._searcher = real
    assert moved == [True, False] and out.count() == 400
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
