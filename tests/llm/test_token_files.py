import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from medledger.llm import queries as Q
from medledger.llm import token_files as T
from tests.llm.cases import none, odd

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def file_of(docs):
    out = io.BytesIO()
    writer = T.Writer(out, wide=False)
    for i, ids in docs:
        writer.add(i, np.array(ids))
    writer.close()
    return out.getvalue()


def test_file_format(monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 4)
    docs = [(None, [0]), (3, [1, 2, 3, 4, 5, 6, 7, 8, 9, 0]), (3, [5, 0]), (9, [])]
    raw = file_of(docs)
    reader = T.Reader(pa.BufferReader(raw))
    assert [reader.document(k).tolist() for k in range(4)] == [ids for _, ids in docs]
    assert reader.null.tolist() == [True, False, False, False] and reader.start.tolist() == [0, 1, 11, 13, 13]
    # A plain zstandard reader finds the ids frame after frame and skips the rest.
    got, rest = b"", raw
    while rest:
        if int.from_bytes(rest[:4], "little") & 0xFFFFFFF0 == 0x184D2A50:
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
            continue
        d = zstandard.ZstdDecompressor().decompressobj()
        got += d.decompress(rest)
        rest = d.unused_data
    assert np.frombuffer(got, "<u2").tolist() == [x for _, ids in docs for x in ids]


def test_damage_is_found():
    raw = bytearray(file_of([(1, list(range(500)) + [0]), (2, [7, 0])]))
    reader = T.Reader(pa.BufferReader(bytes(raw)))
    raw[int(reader.place[0]) + 60] ^= 1
    broken = T.Reader(pa.BufferReader(bytes(raw)))
    assert broken.document(1).tolist() == [7, 0]  # another document's frame is not touched
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.document(0)
    with pytest.raises(ValueError):
        T.Reader(pa.BufferReader(bytes(raw[:-1])))


def test_query_equals_library(spark, library):
    d = "/root/testdata/sf0.001"
    start = 0
    got = {x["doc_id"]: x for x in Q.QUERIES["op5_seekable_token_files"](spark, d).collect()}
    for x in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(x["text"], add_special_tokens=False).ids, 0]
        g = got.pop(x["doc_id"])
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_odd_inputs_and_fetch(spark, library):
    files = T.write(odd(spark), PATH)
    got = sorted(T.read(spark, files).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    start = 0
    for x in got:
        assert x["start"] == start
        start += x["n_tokens"]
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1
    some = T.fetch(spark.createDataFrame([(4,), (8,), (77,), (None,)], "doc_id long"), files).collect()
    assert sorted(x["doc_id"] for x in some) == [4, 4, 8]
    assert {bytes(x["ids"]) for x in some if x["doc_id"] == 8} == {bytes(got[-1]["ids"])}
    assert T.write(none(spark), PATH) == [] and T.read(spark, []).count() == 0


def test_special_tokens_are_text(spark, library):
    codec = T.LibraryCodec(spark, PATH, special_as_text=True).get()
    ids, _, _, _ = codec.encode(pa.array(["x <|endoftext|> y"]))
    assert ids.tolist() == library.encode("x <|endoftext|> y", add_special_tokens=False).ids and 50256 not in ids


def test_special_tokens_are_the_librarys_by_default(spark):
    """The library as it is, with ``add_special_tokens=False``, finds the strings of special tokens itself."""
    as_is = Tokenizer.from_file(PATH)
    texts = ["plain", "x <|endoftext|> y", "", "<|endoftext|>", "a<|endoftext|><|endoftext|> b's <|endoftext", "end"]
    ids, cut, place, _ = T.LibraryCodec(spark, PATH).get().encode(pa.array(texts))
    want = [as_is.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == want and 50256 in want[1]
    assert place[cut[1] : cut[2]].tolist() == [a for a, _ in as_is.encode(texts[1], add_special_tokens=False).offsets]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = T.read(spark, T.write(docs, PATH)).orderBy("doc_id").collect()
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got] == [[*w, 0] for w in want]


def test_other_tokenizer_files_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level BPE"):
        T.LibraryCodec(spark, P.path("word_bpe_49k.json"))


def test_pieces_of_every_kind_are_the_librarys(spark):
    """Also those that are not given to the library in long strings."""
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    codec = T.LibraryCodec(spark, PATH).get()
    pieces = [p.encode() for p in (" word", "word", " 12", "12", " ,;", ",", "  ", " ", "\n\n", "\t", "'s", " \u00a0", "\u3000", " \u00e9t\u00e9", " \u6f22\u5b57", " " + "q" * 3000)]
    flat, size = codec.encode_pieces(pieces)
    want = [plain.encode(p.decode(), add_special_tokens=False).ids for p in pieces]
    assert size.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_a_hot_id_is_in_many_files(spark):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'the same text' AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = T.write(docs, PATH)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) > 3 and sum(f.docs for f in files) == 4000 and max(f.docs for f in files) < 1500
    assert T.read(spark, files).count() == 4000


def test_cache_forgets_what_is_not_used(monkeypatch):
    from medledger.llm import bpe as B
    monkeypatch.setattr(B, "CACHE_PIECES", 50)
    ranks = {bytes([b]): b for b in range(256)}
    codec = B.Codec.of_ranks(B.tiktoken_classes(), ranks)
    for turn in range(30):
        text = " ".join(f"word{turn * k % 71}" for k in range(40)) + " always"
        ids, cut, _, data = codec.encode(pa.array([text, None]))
        assert bytes(ids.astype("u1")) == text.encode() and cut.tolist() == [0, len(text), len(text)]
    assert len(codec.cache.keys) <= 100
