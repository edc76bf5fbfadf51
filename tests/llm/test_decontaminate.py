import random

import numpy as np
import pytest

from medledger.llm import decontaminate as D
from tests.llm.cases import none, odd, words


def brute(doc, items):
    w, hit, found = words(doc), set(), set()
    for i, text in items:
        b = words(text)
        if not b:
            continue
        n = min(13, len(b))
        for k in range(len(b) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 100])
def test_equals_brute_force(spark, pass_bytes):
    r = random.Random(3)
    vocabulary = ["a", "b", "é", "D"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 13, 14, 20, 30, 30])] + [(100, None), (101, "!!"), (7, text(15))]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(90, items[6][1]), (91, "x " + items[5][1] + " y")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in D.scan(a, b, pass_bytes=pass_bytes).collect()}
    for i, t in docs:
        x = got[i]
        assert (x["n_words"], x["n_hit"], list(x["items"]), x["contaminated"]) == brute(t, items)
        assert sum(s["stop"] - s["start"] for s in x["spans"]) == x["n_hit"]


def test_suffix_array_and_longest_matches(spark):
    rng = np.random.default_rng(0)
    for n, k in ((0, 2), (1, 2), (300, 2), (300, 50)):
        s = np.append(rng.integers(1, k + 1, n), [0] * (n > 0))
        n, depth = len(s), 9
        got = D.suffix_array(s, depth)
        keys = [tuple(s[i : i + depth]) for i in got]
        assert keys == sorted(keys) and sorted(got) == list(range(n))
    docs = spark.createDataFrame([(2, "x a b c d y"), (1, "a b c z"), (3, "b c d")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    got = {x["item_at"]: (x["length"], x["doc_id"], x["doc_at"]) for x in D.longest_matches(docs, items).collect()}
    assert got == {0: (4, 2, 1), 1: (3, 2, 2), 2: (2, 2, 3), 3: (1, 2, 4)}


def test_odd_inputs(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "漢字")], "item_id long, text string")
    got = D.scan(odd(spark), items).collect()
    assert len(got) == 10 and sum(x["contaminated"] for x in got) == 4
    assert [list(x["items"]) for x in got if x["doc_id"] == 8] == [["null"]]
    left = D.decontaminate(odd(spark), items)
    assert left.columns == odd(spark).columns and sorted(str(x["doc_id"]) for x in left.collect()) == ["1", "2", "3", "6", "7", "None"]
    assert D.scan(none(spark), items).count() == 0 and D.decontaminate(none(spark), items).count() == 0
    assert D.scan(odd(spark), items.limit(0)).where("contaminated").count() == 0
