"""Phrase fingerprints against a plain parse; edits and successors against a plain loop."""

import hashlib
import random

import numpy as np
import pytest
from cases import NAMES, none, odd
from pyspark.sql import functions as F

from medledger.llm import lz_fingerprint as L
from medledger.llm.text import AS_IS, slice_hashes


def phrases(data):
    """The LZ78 dictionary, by slices."""
    known, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
    return known


def plain(text):
    """The fingerprint by the plain parse, phrase by phrase."""
    zero = np.zeros(1, np.int64)
    values = {int(slice_hashes(np.frombuffer(p, np.uint8), zero, [zero + len(p)], AS_IS)[0][0]) >> 32 for p in phrases((text or "").encode())}
    return sorted(values)[: L.SIZE]


def share(a, b):
    union = sorted({*a, *b})[: L.SIZE]
    return 1.0 if not union else sum(x in a and x in b for x in union) / len(union)


def hexed(values):
    return b"".join(v.to_bytes(4, "big") for v in values).hex()


def brute(rows):
    """Rows (doc_id, text) in falling order of ids."""
    out = []
    for (d, t), (_, after) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), hexed(plain(t)), hexed(plain(edit)),
                    share(plain(t), plain(edit)), share(plain(t), plain(after))))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                               "near_edited", "near_next").collect()), key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "délta", "漢字", "of", "and", "zz" * 9, "x"]) + str(rng.randrange(40)) for _ in range(n))


def test_parse_is_the_plain_one():
    rng = random.Random(5)
    texts = ["", "a", "aaaaaaaaaaaaa", "abababab", prose(rng, 700), "é" * 40, *[prose(rng, k) for k in range(1, 30)]]
    for text, got in zip(texts, L.fingerprints([t.encode() for t in texts]), strict=True):
        assert got.tolist() == plain(text)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_edits_and_successors(spark, parts):
    rng = random.Random(parts)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 9, 40, 300]))) for i in rng.sample(range(1000), 37)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert result(L.edited(df)) == brute(sorted(rows, reverse=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_odd_rows(spark):
    rows = odd(spark).withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.desc_nulls_last("doc_id"), "h").collect()
    assert result(L.edited(odd(spark))) == brute([(r["doc_id"], r["text"]) for r in rows])
    kept = L.fingerprint(odd(spark))
    assert {*NAMES, "fingerprint"} < set(kept.columns)
    assert sorted((r["text"] or "", r["fingerprint"]) for r in kept.collect()) == sorted((r["text"] or "", hexed(plain(r["text"]))) for r in rows)


def test_repeated_rows_a_lone_one_and_none(spark):
    same = spark.range(3000).select(F.lit("k").alias("doc_id"), F.lit("the same text " * 20).alias("text"))
    rows = result(L.edited(same))
    assert len(rows) == 3000 and set(rows) == set(brute([("k", "the same text " * 20)]))
    assert L.edited(none(spark)).count() == L.fingerprint(none(spark)).count() == 0


def test_likeness_follows_shared_text(spark):
    rows = L.edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("n_chars >= 400").agg(
        F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    print(rows)
    assert rows["e"] > 0.3 and rows["e"] > rows["n"] + 0.15
