"""Quality scores from a weak-label model: heuristic labellers, EM, and a hashed linear scorer.

Ten overlapping heuristics each vote good, bad or abstain on every text. Expectation-maximisation over
the counts of vote patterns in the whole corpus (at most ``3**10`` patterns, whatever the corpus) finds
the share of good texts and, per heuristic, how often it votes which way on good and on bad texts,
without any label. The posterior of a pattern labels its documents. A bounded, documented sample of
documents with their posteriors (``sample`` rows, half of them from each side where there are enough,
first in the order of a hash) trains a logistic scorer on hashed features: words, the strings between
words, word shapes and immediate repeats, each as a share of the text. The scorer then scores every whole
text. No labels are read; tests compare the scores with them.

Defined cases: a null text is an empty text; an empty text gets votes like any other (short, no word); a
null id never enters the sample; repeated rows count and are scored row by row; an empty table gives an
empty result; with one side only in the sample, every score is the posterior of the pattern's side (the
bias). Scoring reads the text column only, so other columns may have any name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medledger.llm.sparse import ftrl, sigmoid
from medledger.llm.text import AS_IS, Words, blocks, find_words, mix, ship_package, slice_hashes
from medledger.session import cut_lineage

BITS = 18
SAMPLE = 8000
#: Features of all sampled documents together that the driver holds.
MAX_FEATURES = 40_000_000
SHRINK = 10
BLOCK_BYTES = 1 << 20
#: A text is kept when its score (likelihood of good) is at least this.
THRESHOLD = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_PROSE = np.zeros(256, bool)  # punctuation of prose
_PROSE[[ord(c) for c in ".,;:'\"-!?()"]] = True
_ODD = np.zeros(256, bool)
_ODD[33:127] = True
_ODD &= ~_LETTER & ~_PROSE
_ODD[48:58] = False
_ODD[[ord(c) for c in "+=/@_-"]] = False  # of addresses, numbers and code
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True

GOOD, BAD, ABSTAIN = 1, 2, 0


def statistics(found: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Per row, the counts that the heuristics compare."""
    rows = len(found.first) - 1

    def count(table: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(found.data) + 1, np.int32 if len(found.data) < 2**31 else np.int64)
        np.cumsum(table[found.data], out=upto[1:])
        return np.diff(upto[found.offsets]).astype(float)

    def one(c: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[ord(c)] = True
        return count(table)

    n = np.diff(found.first).astype(float)
    row = found.rows()
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        _, lead = np.unique(mix(hashes ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    return {
        "bytes": np.diff(found.offsets).astype(float), "words": n, "space": count(_SPACE), "letters": count(_LETTER | _DIGIT),
        "upper": count(_UPPER), "lower": count(_LOWER), "odd": count(_ODD), "stops": count(_STOP), "pipes": one("|"),
        "shouts": one("!"), "again": np.bincount(row, again, minlength=rows).astype(float),
        "distinct": np.bincount(row[lead], minlength=rows).astype(float),
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the ten heuristics, one column each."""
    words, solid = np.maximum(s["words"], 1), np.maximum(s["bytes"] - s["space"], 1)
    cased = np.maximum(s["upper"] + s["lower"], 1)

    def by(x: np.ndarray, good, bad) -> np.ndarray:
        return np.where(bad(x), BAD, np.where(good(x), GOOD, ABSTAIN))

    return np.stack([
        by(s["odd"] / solid, lambda x: x < 0.01, lambda x: x > 0.05),            # symbols
        by(s["pipes"] / words, lambda x: x < 0.02, lambda x: x > 0.2),           # table rests
        by(s["upper"] / cased, lambda x: x < 0.25, lambda x: x > 0.5),           # capitals
        by(s["shouts"] / words, lambda x: x < 0.05, lambda x: x > 0.3),          # exclamation
        by(s["again"] / words, lambda x: x < 0.08, lambda x: x > 0.25),          # a word said again at once
        by(s["distinct"] / words, lambda x: x > 0.35, lambda x: (x < 0.2) & (s["words"] < 2000) & (s["words"] > 20)),
        by(s["stops"] / words, lambda x: (x > 0.02) & (x < 0.6), lambda x: x > 1.0),  # ends of sentences
        by(s["letters"] / solid, lambda x: x > 0.85, lambda x: x < 0.7),         # letters and digits
        by(solid / words, lambda x: (x > 2.5) & (x < 12), lambda x: (x > 25) | (s["words"] == 0)),  # word length
        np.where(s["words"] == 0, BAD, ABSTAIN),                                 # no word at all
    ], axis=1)


_PLACES = 3 ** np.arange(10)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of good for each vote pattern (rows of 0, 1, 2), given how many documents have it.

    Votes are taken as independent given the class. The start is the share of good votes; a prior of
    a few counts keeps every heuristic better than chance on the class it votes for, so the classes
    cannot trade places.
    """
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    posterior = np.where(bad > 0, 0.3 * good / np.maximum(good + bad, 1), 0.95)
    for _ in range(rounds):
        joint = []
        for side, prior in ((posterior, (2.0, 6.0, 1.0)), (1 - posterior, (2.0, 1.0, 6.0))):
            mass = side * counts
            p = np.log(max(mass.sum(), 1e-9) / max(counts.sum(), 1e-9))
            for j in range(patterns.shape[1]):
                seen = np.bincount(patterns[:, j], mass, minlength=3) + np.array(prior)
                p = p + np.log(seen / seen.sum())[patterns[:, j]]
            joint.append(p)
        posterior = sigmoid(joint[0] - joint[1])
    return posterior


def features(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and (row, feature, value) with distinct features per row, rows ascending.

    Values are shares of the text's words; one kind of feature sums to about 1, and to less in a short text
    (``SHRINK`` words are added to its count), which says less about itself.
    """
    found = find_words(texts)
    hashes = found.hashes()
    row = found.rows()
    if not len(row):
        empty = np.zeros(0, np.int64)
        return found, hashes, empty, empty, np.zeros(0)
    last = np.concatenate([row[1:] != row[:-1], [True]])
    after = np.where(last, found.offsets[1:][row], np.concatenate([found.starts[1:], [0]]))
    gap = slice_hashes(found.data, found.ends, [after], AS_IS)[0]
    upper = np.concatenate([[0], np.cumsum(_UPPER[found.data])])
    capitals = upper[found.ends] - upper[found.starts]
    length = found.ends - found.starts
    shape = np.minimum(length, 15) * 4 + (capitals > 0) + 2 * (capitals * 2 > length)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])])
    kinds = (hashes, gap, shape.astype(np.uint64), again.astype(np.uint64))
    feature = np.concatenate([
        (mix(h ^ np.uint64(0x2545F4914F6CDD1D * (k + 1) & (2**64 - 1))) >> np.uint64(64 - BITS)).astype(np.int64) for k, h in enumerate(kinds)])
    pairs, count = np.unique((np.tile(row, 4) << BITS) | feature, return_counts=True)
    row_of = pairs >> BITS
    return found, hashes, row_of, pairs & ((1 << BITS) - 1), count / (np.diff(found.first)[row_of] + SHRINK)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        _, _, row, feature, value = features(texts)
        return sigmoid(np.bincount(row, self.weights[feature] * value, minlength=len(texts)) + self.bias)


def _pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1, BLOCK_BYTES):
        found = find_words(block.column(1))
        code = votes(statistics(found, found.hashes())) @ _PLACES
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(code, pa.int64())], names=["id", "pattern"])


def vote_patterns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and vote pattern (a base-3 number, one place per heuristic)."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(_pattern, "id long, pattern long")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1, BLOCK_BYTES):
        _, _, row, feature, value = features(block.column(1))
        cut = pa.array(np.searchsorted(row, np.arange(block.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.ListArray.from_arrays(cut, pa.array(feature, pa.int32())),
             pa.ListArray.from_arrays(cut, pa.array(value, pa.float32())), block.column(2)], names=["target", "features", "values", "id"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, l1: float = 0.5,
        max_features: int = MAX_FEATURES) -> Scorer:
    """Train on at most ``sample`` documents, half of them thought good, with at most ``max_features`` features together."""
    spark = docs.sparkSession
    found = cut_lineage(vote_patterns(docs, doc_id, text))
    counted = found.groupBy("pattern").count().collect()  # at most 3**10 rows
    code = np.array([r["pattern"] for r in counted], np.int64)
    posterior = expectation_maximisation(code[:, None] // _PLACES % 3, np.array([r["count"] for r in counted], float))
    good = [int(c) for c, p in zip(code, posterior, strict=True) if p >= 0.5]
    unique = found.dropna().groupBy("id").agg(F.min("pattern").alias("pattern"))
    is_good = F.col("pattern").isin(good) if good else F.lit(False)
    known = dict(zip(code.tolist(), posterior.tolist(), strict=True))
    picked = [(r["id"], known[r["pattern"]]) for side in (is_good, ~is_good)
              for r in unique.where(side).orderBy(F.xxhash64("id"), "id").limit(sample // 2).collect()]
    if not picked:
        return Scorer(np.zeros(1 << BITS), 0.0)
    targets = spark.createDataFrame(picked, "id long, target double")
    chosen = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(targets), "id")
    # One row a sampled id, chosen on the executors: an id on very many rows weighs and moves as much as any other.
    chosen = chosen.groupBy("id", "target").agg(F.min("text").alias("text"))
    kind = "target double, features array<int>, values array<float>"
    made = cut_lineage(chosen.select("target", "text", "id").mapInArrow(_sampled, f"{kind}, id long"))
    # The sample shrinks, in hash order, to ``max_features``.
    size = made.select("id", F.size("features").alias("n"), F.xxhash64("id").alias("at")).collect()
    upto, kept = 0, []
    for r in sorted(size, key=lambda r: (r["at"], r["id"])):
        upto += r["n"]
        if kept and upto > max_features:
            warnings.warn(f"quality: {len(kept)} of {len(size)} sampled documents have {max_features} features; the others are not learned from", stacklevel=2)
            made = made.join(F.broadcast(spark.createDataFrame([(i,) for i in kept], "id long")), "id", "left_semi")
            break
        kept.append(r["id"])
    x, v, y = [], [], []
    for r in made.orderBy(F.xxhash64("id"), "id").select("target", "features", "values").toLocalIterator():
        x.append(np.array(r["features"], np.int64))
        v.append(np.array(r["values"]) * 10)
        y.append(r["target"])
    weights, bias = ftrl(x, v, np.array(y), 1 << BITS, l1=l1, rate=0.5, epochs=4)
    # The sample has other shares of good and bad than the corpus has.
    odds = lambda share: np.log((share + 1e-3) / (1 - share + 1e-3))
    amount = np.array([r["count"] for r in counted], float)
    return Scorer(weights * 10, bias + odds(float((posterior * amount).sum() / amount.sum())) - odds(float(np.mean(y))))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the likelihood that a row is good (0 to 1) added as the last column ``name``."""
    spark = docs.sparkSession
    ship_package(spark)
    columns, at = docs.columns, docs.columns.index(text)
    held = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at, BLOCK_BYTES):
            made = pa.array(held.value.score(block.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*block.columns, made], names=[f"c{i}" for i in range(len(columns) + 1)])

    kind = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = docs.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, f"{kind}, c{len(columns)} double")
    return out.toDF(*columns, name)
