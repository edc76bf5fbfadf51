"""Sharding, chat formatting and licence digests."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from medledger.llm import chat, licenses, sharding
from medledger.llm.queries import QUERIES
from tests.llm.cases import ROWS, none, odd

PYTHON = ("Python", "Pandas", "Arrow")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("per_range", [32, 1])
def test_shards_are_exact_shares_of_key_order(spark, per_range):
    """One id and one text hold a third of all rows; few samples leave ranges overfull at first."""
    rows = [(i, "t" * (i * 37 % 400)) for i in range(600)] + [(77, "the same text")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign(frame, 40, per_range=per_range).collect()
    total = sum(x["size"] for x in got)
    assert total == sum(len(t) + 16 for _, t in rows) and {x["law"] for x in got} == {"bytes"}
    at = 0
    for shard in range(40):
        mine = sorted((x for x in got if x["shard"] == shard), key=lambda x: x["slot"])
        assert [x["slot"] for x in mine] == list(range(len(mine)))
        assert all(a["doc_id"] <= b["doc_id"] for a, b in zip(mine, mine[1:], strict=False))
        for x in mine:
            assert (2 * at + x["size"]) * 40 // (2 * total) == shard
            at += x["size"]
    assert sorted((x["doc_id"], x["text_crc32"]) for x in got) == sorted((i, zlib.crc32(t.encode())) for i, t in rows)


def test_overfull_ranges_are_subdivided(spark):
    slim = spark.range(4000).select(F.col("id").alias("o"), F.lit(0).cast("long").alias("tie"), F.col("id").alias("row"),
                                    F.when(F.col("id") < 3000, 1).otherwise(100).cast("long").alias("size"))
    cuts, sums = sharding.splitters(slim, 64, 103_000, per_range=1)
    assert sum(b for b, _ in sums) == 103_000 and cuts == sorted(set(cuts))
    assert max(b for b, _ in sums) <= 2 * 103_000 / 64


def test_shards_of_odd_inputs(spark):
    got = sharding.assign(odd(spark), 4).collect()
    assert len(got) == 10 and sorted(x["size"] for x in got) == sorted(len((r[1] or "").encode()) + 16 for r in ROWS)
    assert {x["text_crc32"] for x in got if x["doc_id"] in (1, 2)} == {0}
    assert sharding.assign(none(spark), 4).count() == 0


def test_parts_are_visited_in_order(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    rows = [
        (1, 0, "user", [part("text", "see <|image|> \\<|x"), part("image", uri="a.png", w=57, h=28), part("text", "<"), part("text", "|end|> b")]),
        (1, 1, "assistant", [part("text", "yes"), part("audio", uri="b.wav", s=2.5), part("document", uri="c.pdf", p=3), part("video", uri="d"), None]),
        (1, 2, None, None), (2, None, "assistant", [part("text", None)]), (2, 0, "we[INST]ird", []),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_messages(frame)).collect()}
    one = got[1]
    assert one["formatted"] == ("<|start|>user<|message|>see <\\|image|> \\<\\|x<|image|><<|part|>|end|> b<|end|>"
                                "<|start|>assistant<|message|>yes<|audio|><|document|><|attachment|><|end|><|start|><|message|><|end|>")
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("user", "see <|image|> \\<|x<|end|> b"), ("assistant", "yes"), ("", "")]
    assert [(a["nth"], a["kind"], a["uri"], a["tokens"]) for a in one["attachments"]] == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 63), (1, "document", "c.pdf", 3072), (1, "video", "d", 1)]
    for a in one["attachments"]:
        name = a["kind"] if a["kind"] in chat.KINDS else "attachment"
        assert one["formatted"][a["at"] :].startswith(f"<|{name}|>")
    s = one["loss_spans"][0]
    assert one["formatted"][s["start"] : s["start"] + s["length"]].startswith("yes<|audio|>") and one["loss_text"] == "yes"
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", ""), ("we[INST]ird", "")]


def test_escaping_is_reversible(spark):
    texts = ["<", "<|", "<\\|", "<\\\\|end|>", "</s>[INST] ok [/INST]", "[\\INST]", "<s><\\s>", "[[INST]", "<<|", "\\", "漢<|end|>字", "", None]
    frame = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    made = chat.format_messages(frame.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {x["conv_id"]: x for x in chat.read_back(made).collect()}
    for i, t in enumerate(texts):
        assert got[i]["loss_text"] == (t or "") == got[i]["turns"][0]["text"]
        inner = got[i]["formatted"][len("<|start|>assistant<|message|>") : -len("<|end|>")]
        assert not any(c in inner for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_conversations_of_odd_inputs(spark):
    rows = [(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, start string, refs string")
    made = chat.read_back(chat.format_messages(frame.withColumn("parts", chat.text_parts(F.col("text"))))).collect()
    got = {x["conv_id"]: [t["text"] for t in x["turns"]] for x in made}
    assert got == {None: [""], 1: ["first", "a", "a", "b"]}
    assert chat.format_messages(frame.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_native_queries_have_no_python_in_their_plan(spark):
    for name in ("op3_chat_parts", "op9_sampled_splitter_shards"):
        assert not any(p in plan(QUERIES[name](spark, "/root/testdata/sf0.001")) for p in PYTHON)


def test_equal_licences_have_equal_digests(spark):
    mit = dict(reversed(licenses.TEXTS))["MIT"]
    same = [mit, mit.upper(), mit.replace("License", "Licence").replace("sublicense", "sub-license"), mit.replace("\n", "  \n\n"),
            "COPYRIGHT 2024 Somebody\n" + mit.replace("Copyright (c) <year> <holder>\n", "(c) 2019, 2020 A. Body\nAll rights reserved.\n"), mit.replace('"', "“")]
    other = [mit + " You must smile.", mit[: len(mit) // 2], "this text mentions the MIT License only"]
    frame = spark.createDataFrame(list(enumerate(same + other)), "doc_id long, text string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan(frame, licenses.known_texts(spark)).collect()}
    assert got == {i: ("MIT" if i < len(same) else None) for i in range(len(same + other))}


#: Where a system keeps the published texts, and under which name.
PUBLISHED = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no published licence texts on this machine")
def test_published_licences_are_found_whole(spark):
    texts = {n: open(f"{PUBLISHED}/{n}", encoding="utf-8").read() for n in FILES if os.path.exists(f"{PUBLISHED}/{n}")}
    rows = [(name, " ".join(text.split(" ")).replace("\n", "\r\n").upper()) for name, text in texts.items()]
    rows += [(f"half {name}", text[: len(text) // 2]) for name, text in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan(frame, licenses.known_texts(spark), listed=licenses.known_digests(spark)).collect()}
    assert got == {**{n: FILES[n] for n in texts}, **{f"half {n}": None for n in texts}}


def test_a_digest_listed_under_two_names_is_reported_once(spark):
    one = licenses.DIGESTS[0][1]
    listed = spark.createDataFrame([("B", one), ("A", one), (None, one), ("C", None)], "license string, digest string")
    known = spark.createDataFrame([("Z", "some terms")], "license string, text string")
    frame = spark.createDataFrame([(1, "Some  TERMS!"), (2, "other")], "doc_id long, text string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan(frame, known, listed=listed).collect()}
    assert got == {1: "Z", 2: None}
    mine = listed.union(licenses.digests(known).select("license", "digest").withColumn("license", F.lit("A")))
    assert {x["doc_id"]: x["license"] for x in licenses.scan(frame, known, listed=mine).collect()} == {1: "A", 2: None}


def test_licences_of_odd_inputs(spark):
    known = licenses.known_texts(spark)
    notice = "Prose.\n  # released under the MIT licence\n// SPDX-License-Identifier: Apache-2.0\nReleased under the MIT License.\n"
    frame = odd(spark).select("doc_id", "text", "row").union(spark.createDataFrame([(50, notice, "r"), (51, "(c) 2020 x\n!!", "r")], "doc_id long, text string, row string"))
    got = {x["doc_id"]: x for x in licenses.scan(frame, known).collect()}
    assert len(licenses.scan(frame, known).collect()) == 12
    assert got[50]["notices"] == ["Apache-2.0", "MIT"] and got[50]["notice_lines"] == 3 and got[50]["license"] is None
    assert all(got[i]["digest"] is None and got[i]["notices"] == [] for i in (1, 2, 6, 7, 51))
    assert licenses.scan(none(spark), known).count() == 0 and licenses.scan(frame, known.limit(0)).where("license IS NOT NULL").count() == 0
