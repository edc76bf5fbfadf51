"""The corpus pipeline: documents to clean, distinct, uncontaminated, encoded documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame,
which is written as Parquet in the shared checkpoint folder and read again as the next one's ``docs``. All
but the last return the columns of ``docs``. Stages:

1. toxicity: a factorization machine trained on ``labels``; rows with a score of 0.7 or more go.
2. quality: a scorer trained on weak labels; rows that it finds more likely bad than good go.
3. near_dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) the one with the
   smallest id stays.
4. decontaminate: documents with benchmark windows on one word in 20 or more go.
5. bpe: whole texts are encoded and decoded; one row per document with its token count and digests.

Null and empty texts, repeated rows, null ids and extra columns are handled as each operator's docstring
says; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medledger.llm import bpe, decontaminate, near_dedup, quality, toxicity
from medledger.session import cut_lineage


def _below(scored: DataFrame, keep) -> DataFrame:
    """The rows whose last column (a score) is kept, without it; positional, so any input names will do."""
    columns = scored.columns
    inner = scored.toDF(*[f"c{i}" for i in range(len(columns))])
    score = inner.columns[-1]
    return inner.where(keep(F.col(score))).drop(score).toDF(*columns[:-1])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _below(toxicity.score(docs, machine), lambda s: s < toxicity.THRESHOLD)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _below(quality.score(docs, quality.fit(docs)), lambda s: s >= quality.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs.select("doc_id", "text"), ranks).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("near_dedup", distinct),
    ("decontaminate", uncontaminated),
    ("bpe", encoded),
]

#: Trained models decide the first two stages, so there is no SQL for the rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
