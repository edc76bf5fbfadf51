import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from medledger.llm import bpe
from medledger.llm import queries as Q
from tests.llm.cases import ROWS, none, odd

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of_ranks(bpe.tiktoken_classes(), bpe.read_ranks(PATH))


def test_scan_is_composition():
    rng = np.random.default_rng(0)
    for n in (1, 5, 128, 129, 20_000):
        f = bpe.FUNCTION[rng.integers(0, 16, n)]
        state, want = 0, []
        for x in f:
            state = bpe.APPLY[x, state]
            want.append(state)
        assert (bpe.APPLY[bpe.scan(f), 0] == want).all()


def test_equals_library_on_random_texts(codec, library):
    r = random.Random(1)
    signs = "ab 's're'll  \n\t   é1२३!?.,'\"😀ñ中文ʼ'tdmvl\r‍́"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "hello " * 300, "xyzzy" * 200, "", "'", "  ", "x  ", " 's", "it's we'll 'sa", "ñ" * 700]
    texts += [f"a{chr(k)}1{chr(k)}!{chr(k)} {chr(k)}" for k in [*range(1, 0xD800, 23), *range(0xE000, 0x33000, 97)]]
    ids, cut, place, data = codec.encode(pa.array(texts))
    for i, t in enumerate(texts):
        own = ids[cut[i] : cut[i + 1]].tolist()
        assert own == library.encode_ordinary(t), t
        raw = t.encode()
        at = place[cut[i] : cut[i + 1]].tolist()
        assert [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)][: len(at)], strict=True)] == [library.decode_single_token_bytes(x) for x in own]


def test_hash_collisions_do_not_pass(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "slice_hashes", lambda data, starts, ends, fold: [np.zeros(len(starts), np.uint64)])
    fresh = bpe.Codec.of_ranks(codec.classes, bpe.read_ranks(PATH))
    ids, cut, _, _ = fresh.encode(pa.array(["some words here", "and others"]))
    assert ids[: cut[1]].tolist() == library.encode_ordinary("some words here")


def test_encode_decode_and_digests(spark, library):
    frame = bpe.decode(bpe.encode(odd(spark).drop("ids", "starts"), PATH), PATH).collect()
    assert len(frame) == len(ROWS)
    for x in frame:
        assert x["ids"] == library.encode_ordinary(x["text"] or "") and bytes(x["decoded"]) == (x["text"] or "").encode()
    made = bpe.digests(odd(spark), PATH)
    assert made.columns == [*odd(spark).columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    for x in made.collect():
        ids = library.encode_ordinary(x["text"] or "")
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256((x["text"] or "").encode()).hexdigest()
    assert bpe.encode(none(spark), PATH).count() == 0 and bpe.digests(none(spark), PATH).count() == 0


def test_query_equals_library(spark, library):
    d = "/root/testdata/sf0.001"
    told = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = Q.QUERIES["op8_vectorised_bpe"](spark, d).collect()
    assert len(got) == len(told)
    for x in got:
        ids = library.encode_ordinary(told[x["doc_id"]])
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
