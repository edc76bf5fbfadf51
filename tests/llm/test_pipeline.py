import hashlib

import pyarrow as pa
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from medledger.llm import bpe, quality, queries, toxicity
from medledger.session import cut_lineage
from tests.llm.cases import none, odd
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    """Every stage on its own input, and run() against all of them together."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in docs.select("doc_id", "text").collect()]
        texts = pa.array([t for _, t in before])
        if name == "toxicity":
            score = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).score(texts)
            want = {i for (i, _), s in zip(before, score, strict=True) if s < 0.7}
        elif name == "quality":
            score = quality.fit(docs).score(texts)
            want = {i for (i, _), s in zip(before, score, strict=True) if s >= 0.5}
        elif name == "near_dedup":
            want = {i for i, root in groups(sorted(before)).items() if i == root}
        elif name == "decontaminate":
            want = {i for i, t in before if not hits(t, items)[3]}
        else:
            want = {i for i, _ in before}
        columns, docs = docs.columns, cut_lineage(stage(spark, docs, SF))
        assert {x["doc_id"] for x in docs.select("doc_id").collect()} == want and docs.count() == len(want)
        assert name == "bpe" or docs.columns == columns
    end = {x["doc_id"]: x for x in docs.collect()}
    for i, t in before:
        ids = library.encode_ordinary(t)
        assert (end[i]["n_tokens"], end[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_inputs_pass_through_all_stages(spark):
    for frame in (odd(spark), none(spark)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, SF))
            assert name == "bpe" or docs.columns == frame.columns
        assert docs.count() <= 8


def test_registered_queries_cover_all_operators():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontaminate", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
