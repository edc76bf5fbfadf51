"""Importance resampling against a brute-force version; exact ranks whatever the ranges."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import NAMES, none, odd, words
from pyspark.sql import functions as F

from medledger.llm import importance as I
from medledger.llm.text import find_words


def grams(text, buckets=I.BUCKETS):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, wanted, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = (Counter(g for _, x in rows for g in grams(x)) for rows in (docs, wanted))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + 10000) / ((s[k] + 1) * (big_t + 10000))))
    out = []
    for d, x in docs:
        weight = sum(gain(k) for k in grams(x))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r, (_, x) in zip(out, docs, strict=True) if len(words(x)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, 0 if r[0] is None else r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_buckets_of_all_runs():
    rng = random.Random(3)
    texts = [" ,".join("".join(rng.choice("abÄ漢Z9") for _ in range(rng.choice((1, 3, 9, 70, 200)))) for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)]
    got = Counter()
    for _, crcs, there in I.features(find_words(pa.array([*texts, None]))):
        for bucket, ok in zip(crcs, there, strict=True):
            got.update(bucket[ok].tolist())
    assert got == Counter(g for t in texts for g in grams(t))


def test_segments_change_nothing(monkeypatch):
    found = find_words(pa.array(["one two three four five six seven", "", "a b", "c", "d e f g h i j k l m n"]))
    whole = next(iter(I.features(found)))
    monkeypatch.setattr(I, "SEGMENT", 3)
    for k in range(3):
        parts = [(c[k][o[k]]) for _, c, o in I.features(found)]
        assert np.concatenate(parts).tolist() == whole[1][k][whole[2][k]].tolist()


def test_odd_rows(spark):
    got = I.resample(odd(spark), odd(spark).where("doc_id > 3"), percent=50, min_words=5)
    docs = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    assert rows(got) == brute(docs, [d for d in docs if d[0] and d[0] > 3], 50, 5)
    assert not set(NAMES) & set(got.columns) - {"score"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ties_and_a_hot_id(spark, kind):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(25)) for _ in range(12)]
    docs = [(rng.choice([None, 5, 5, 5, k]), rng.choice(texts)) for k in range(600)]
    docs = [(None if d is None else str(d) if kind == "string" else d, t) for d, t in docs]
    df = spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(7)
    assert rows(I.resample(df, df.limit(0), percent=40)) == brute(docs, [], 40)


def test_ranks_are_exact_in_any_number_of_ranges(spark):
    scored = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"),
        F.lit(0).cast("long").alias("weight"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 1000).alias("score"))
    want = {r["doc_id"]: k for k, r in enumerate(sorted(scored.collect(), key=lambda r: (-r["score"], r["doc_id"])), 1)}
    for ranges in (1, 2, 50):
        assert {r["doc_id"]: r["rank"] for r in I.ranked(scored, ranges).collect()} == want


def test_empty_tables(spark):
    assert I.resample(none(spark), odd(spark)).count() == 0
    assert {r["rank"] for r in I.resample(odd(spark), none(spark), percent=0).collect()} == {None}
