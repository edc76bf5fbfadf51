"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct words and their prefixes of 4, 5 and 6 bytes (so that an insult is
known in its inflected forms), hashed into ``2**BITS`` features of value 1 or 0. The machine adds linear
weights and, for every pair of terms present, the product of their factor vectors, so that it learns
pairs such as an insult with a group mention that no sum of single weights can express. Every term of at
least ``MIN_DOCS`` documents of the sample is in the machine. Weights and factors are trained by AdaGrad in two
passes: first the strong terms, those whose share of toxic documents differs from the overall share by
``SCREEN`` standard deviations, then all terms together on what the strong ones leave unexplained, so a
rare toxic term and a term that matters only beside another one are learned too. The others are held by L2 in the
second pass (``RIDGE_W`` and ``RIDGE_V``, spread over a term's documents) and their own weights are not
negative: a long text is not swayed, and not talked clean, by its many ordinary words; their pairs may lower a
score. Whole texts of any length are scored in Arrow batches, with no shuffle.

Training reads a bounded sample of labelled documents: at most ``per_class`` documents of each label,
the first in the order of a hash of their id, each with one row (the smallest text of its id), and at most
``max_terms`` terms in all: beyond that the sample ends earlier in that order, for both labels at the same share
of their documents. Everything else (scoring) covers every document whole.

Defined cases: a null or empty text has no terms and gets the score of the bias alone; a document
with several labels counts as toxic if any of them says so; null labels and null ids are not learned
from; without a label of each class every score is 0.5; repeated rows are scored row by row; an empty
table gives an empty result. Scores read the text column only, so other columns may have any name.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medledger.llm.sparse import flat, row_sums, sigmoid
from medledger.llm.text import blocks, find_words, mix, ship_package, slice_hashes
from medledger.session import cut_lineage

BITS = 20
PREFIXES = (4, 5, 6)
RANK = 4
THRESHOLD = 0.7
PER_CLASS = 3000
MAX_TERMS = 20_000_000
#: A term that fewer documents of the sample have gets no weight.
MIN_DOCS = 3
SCREEN = 5.0
#: L2 on the weights and on the factors of the terms that are not strong, and on the factors of paired ones.
RIDGE_W, RIDGE_V, RIDGE_PAIR = 1.0, 3000.0, 3.0
#: Misjudged training rows beyond which pairs of weakly tied terms are looked for.
TOLERATED = 0.02
#: For the pair matrix: rows added to each term's number, how far an eigenvalue must be above chance, a term's least part
#: in the directions (1: an equal share).
DAMPING, ABOVE, PART = 20.0, 1.2, 3.0
#: The bias is not trained below this: a text without a known term is no proof, and one insult must be able to outweigh it.
LEAST_BIAS = -1.5
BLOCK_BYTES = 1 << 20


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every term occurrence, rows ascending within each kind of term."""
    found = find_words(texts)
    length = found.ends - found.starts
    ends = [found.ends, *(np.minimum(found.starts + k, found.ends) for k in PREFIXES)]
    row = found.rows()
    rows, features = [], []
    for k, h in zip((0, *PREFIXES), slice_hashes(found.data, found.starts, ends), strict=True):
        has = np.flatnonzero(length >= max(k, 1))
        rows.append(row[has])
        features.append((mix(h[has] ^ np.uint64(k * 0x51ED2701)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((row << BITS) | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Machine:
    """Bias, and per active feature (ascending ids) a weight and a factor vector."""

    bias: float
    ids: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def place(self, feature: np.ndarray) -> np.ndarray:
        """Index of each feature among the active ones, or -1."""
        if not len(self.ids):
            return np.full(len(feature), -1)
        at = np.minimum(np.searchsorted(self.ids, feature), len(self.ids) - 1)
        return np.where(self.ids[at] == feature, at, -1)

    def score(self, texts: pa.Array) -> np.ndarray:
        row, feature = terms(texts)
        table = np.zeros(1 << BITS, dtype=bool)
        table[self.ids] = True
        live = table[feature]
        row, feature = distinct(row[live], feature[live])
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        return sigmoid(self.margin(self.place(feature), cut))

    def margin(self, at: np.ndarray, cut: np.ndarray) -> np.ndarray:
        v = self.factors[at]
        pairs = (row_sums(v, cut) ** 2 - row_sums(v * v, cut)).sum(axis=1) / 2
        return self.bias + row_sums(self.weights[at], cut) + pairs


def _usual(rows: list[np.ndarray], labels: np.ndarray, screen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of at least ``MIN_DOCS`` documents, how many have each, and whether its label share is off the overall share by ``screen`` deviations."""
    n, off = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    share = labels.mean()
    for row, label in zip(rows, labels, strict=True):
        n[row] += 1
        off[row] += label - share
    ids = np.flatnonzero(n >= MIN_DOCS)
    n = n[ids]
    return ids, n, np.abs(off[ids]) >= screen * np.sqrt(n * share * (1 - share))


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 11, epochs: int = 20, rate: float = 0.1,
          l2: float = 1e-4, screen: float = SCREEN, more_epochs: int = 10) -> Machine:
    """Fit a machine on rows of distinct features: ``epochs`` over the strong terms, ``more_epochs`` over all.

    Where that leaves more than ``TOLERATED`` of the rows on the wrong side of ``THRESHOLD``, single terms do not tell the
    labels: then a machine with paired terms (see ``_fit``) is tried, and taken if it misjudges fewer of a fifth of the
    rows when both learn from the others.
    """
    def fit(part: np.ndarray, paired: bool) -> Machine:
        return _fit([rows[i] for i in part], labels[part], seed, epochs, rate, l2, screen, more_epochs, paired)

    every = np.arange(len(rows))
    plain = fit(every, False)
    if not len(plain.ids) or _wrong(plain, rows, labels) <= TOLERATED:
        return plain
    kept_out = np.random.default_rng(seed).permutation(len(rows)) < len(rows) // 5
    inner, outer = every[~kept_out], [rows[i] for i in every[kept_out]]
    if len(np.unique(labels[inner])) < 2:
        return plain
    wrong = [_wrong(fit(inner, paired), outer, labels[kept_out]) for paired in (False, True)]
    return fit(every, True) if wrong[1] < wrong[0] else plain


def _wrong(m: Machine, rows: list[np.ndarray], labels: np.ndarray) -> float:
    """The share of rows that a machine puts on the wrong side of ``THRESHOLD``."""
    wrong = 0
    for a in range(0, len(rows), 64):
        at, cut = flat([p[p >= 0] for p in map(m.place, rows[a : a + 64])])
        wrong += int(((sigmoid(m.margin(at.astype(np.int64), cut)) >= THRESHOLD) != (labels[a : a + 64] > 0.5)).sum())
    return wrong / max(1, len(rows))


def _directions(active: list[np.ndarray], n: np.ndarray, rest: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and vectors of the pair matrix: for two terms, what is left of the labels summed over the
    rows that have both, scaled by how many rows have each. Subspace iteration; the matrix is never built."""
    at, cut = flat(active)
    at, per, scale = at.astype(np.int64), np.repeat(np.arange(len(active)), np.diff(cut)), 1 / np.sqrt(n + DAMPING)
    own = np.bincount(at, rest[per], minlength=len(n)) * scale * scale

    def times(u: np.ndarray) -> np.ndarray:
        x = row_sums((u * scale[:, None])[at], cut) * rest[:, None]
        summed = np.stack([np.bincount(at, x[per, k], minlength=len(n)) for k in range(x.shape[1])], axis=1)
        return summed * scale[:, None] - own[:, None] * u

    u = np.linalg.qr(draw.normal(size=(len(n), 2 * RANK)))[0]
    for _ in range(6):
        u = np.linalg.qr(times(u))[0]
    top = np.abs(np.linalg.eigvalsh(u.T @ times(u))).max()
    for _ in range(40):  # shifted, so that the largest are not the most negative ones
        u = np.linalg.qr(times(u) + top * u)[0]
    value, vector = np.linalg.eigh(u.T @ times(u))
    order = np.argsort(-value)[:RANK]
    return value[order], (u @ vector[:, order]) * scale[:, None]


def _fit(rows: list[np.ndarray], labels: np.ndarray, seed: int, epochs: int, rate: float, l2: float, screen: float,
         more_epochs: int, paired: bool) -> Machine:
    """A machine trained on the strong terms, then on all.

    ``paired`` starts the factors of weakly tied terms from the pair matrix of what the strong terms leave of the labels:
    the directions whose eigenvalue is ``ABOVE`` that of the same matrix with random signs, and the terms with a part in
    them. These terms' factors are held lightly, their weights may have any sign, and the bias of the last pass counts.
    """
    none = Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK)))
    if len(np.unique(labels)) < 2:
        return none
    ids, n, strong = _usual(rows, labels, screen)
    draw = np.random.default_rng(seed)
    # The factors of the others start at 0 and grow beside terms that have some; without strong terms all start as those do.
    apart = strong if strong.any() or paired else np.ones(len(ids), bool)
    m = Machine(0.0, ids, np.zeros(len(ids)), np.where(apart[:, None], draw.normal(0, 0.01, (len(ids), RANK)), 0.0))
    active = [p[p >= 0] for p in map(m.place, rows)]
    pair = np.zeros(len(ids), bool)
    # Of the last pass: a bias below the floor, so that ordinary words do not stand in for it. Without paired terms, scores do without it.
    shift = 0.0
    for all_terms, rounds, start in ((False, epochs, 1e-6), (True, more_epochs, 1.0)):
        used = active if all_terms else [a[strong[a]] for a in active]
        if all_terms and paired:
            at, cut = flat([a[strong[a]] for a in active])
            rest = labels - sigmoid(m.margin(at.astype(np.int64), cut))
            rest -= rest.mean()
            value, vector = _directions(active, n, rest, draw)
            chance, _ = _directions(active, n, rest * draw.choice([-1.0, 1.0], len(rest)), draw)
            real = value > ABOVE * chance[0]
            part = ((vector[:, real] * np.sqrt(n + DAMPING)[:, None]) ** 2).sum(axis=1) * len(ids)
            pair = ~strong & (part > PART * max(1, real.sum()))
            if pair.any():
                begin = vector * real
                m.factors[pair] = 0.5 * begin[pair] / np.abs(begin[pair]).max()
                rounds, start = epochs, 1e-2
        hold_w = np.where(strong, l2, RIDGE_W / n)
        hold_v = np.where(strong, l2, np.where(pair, RIDGE_PAIR, RIDGE_V) / n)
        sum_w, sum_v, sum_b = np.full(len(ids), start), np.full((len(ids), RANK), start), 1e-6
        for _ in range(rounds):
            for pick in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // 32)):
                at, cut = flat([used[i] for i in pick])
                at = at.astype(np.int64)
                error = sigmoid(m.margin(at, cut) + shift) - labels[pick]
                v, per = m.factors[at], np.repeat(np.arange(len(pick)), np.diff(cut))
                gv = error[per, None] * (row_sums(v, cut)[per] - v)
                here, back, times = np.unique(at, return_inverse=True, return_counts=True)
                gw = np.bincount(back, error[per], minlength=len(here))
                gf = np.stack([np.bincount(back, gv[:, f], minlength=len(here)) for f in range(RANK)], axis=1)
                gb = float(error.sum())
                sum_w[here] += gw * gw
                sum_v[here] += gf * gf
                sum_b += gb * gb
                # A step down the error, then the L2 in closed form (stable however large it is).
                step_w, step_v = rate / np.sqrt(sum_w[here]), rate / np.sqrt(sum_v[here])
                w = (m.weights[here] - step_w * gw) / (1 + step_w * hold_w[here] * times)
                m.weights[here] = np.where(strong[here] | pair[here], w, np.maximum(w, 0.0))
                m.factors[here] = (m.factors[here] - step_v * gf) / (1 + step_v * (hold_v[here] * times)[:, None])
                if all_terms:
                    shift -= rate * gb / np.sqrt(sum_b)
                else:
                    m.bias = max(LEAST_BIAS, m.bias - rate * gb / np.sqrt(sum_b))
    if pair.any():
        m.bias += shift
    return m


def held_out(doc_id):
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, 1, BLOCK_BYTES):
        row, feature = distinct(*terms(block.column(1)))
        cut = np.searchsorted(row, np.arange(block.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))
        yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), lists], names=["id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS, max_terms: int = MAX_TERMS) -> Machine:
    """Train on a bounded sample of ``labels`` (columns ``doc_id`` and ``label``) whose documents are in ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    known = known.join(docs.select(F.col(doc_id).cast("long").alias("id")), "id", "left_semi")
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = [(r["id"], r["label"]) for p in picked for r in p.collect()]  # at most 2 * per_class rows
    if not sample:
        return train([], np.zeros(0))
    wanted = spark.createDataFrame(sample, "id long, label int")
    chosen = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(wanted), "id")
    chosen = chosen.groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = "id long, label int, features array<int>"
    made = cut_lineage(chosen.select("id", "text", "label").mapInArrow(_features, kind))
    size = {r["id"]: r["n"] for r in made.select("id", F.size("features").alias("n")).collect()}
    place = {i: at for at, i in enumerate(_within([[i for i, y in sample if y == side] for side in (0, 1)], size, max_terms))}
    if len(place) < len(sample):
        warnings.warn(f"toxicity: {len(place)} of {len(sample)} sampled documents have {max_terms} terms; the others are not learned from", stacklevel=2)
        made = made.join(F.broadcast(spark.createDataFrame([(i,) for i in place], "id long")), "id", "left_semi")
    rows, targets = [np.zeros(0, np.int64)] * len(place), np.zeros(len(place))
    for r in made.toLocalIterator():
        rows[place[r["id"]]], targets[place[r["id"]]] = np.array(r["features"], np.int64), r["label"]
    return train(rows, targets)


def _within(classes: list[list[int]], size: dict[int, int], limit: int) -> list[int]:
    """The first ids of every class, an equal share of each, whose sizes sum to at most ``limit``; at least the first of each."""
    order = sorted((at / len(ids), side, i) for side, ids in enumerate(classes) for at, i in enumerate(ids))
    kept, total = [], 0
    for share, _, i in order:
        total += size[i]
        if share and total > limit:
            break
        kept.append(i)
    return kept


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 per row (more likely toxic is higher) added as the last column ``name``."""
    spark = docs.sparkSession
    ship_package(spark)
    columns, at = docs.columns, docs.columns.index(text)
    held = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at, BLOCK_BYTES):
            made = pa.array(held.value.score(block.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*block.columns, made], names=[f"c{i}" for i in range(len(columns) + 1)])

    kind = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = docs.toDF(*[f"c{i}" for i in range(len(columns))]).mapInArrow(run, f"{kind}, c{len(columns)} double")
    return out.toDF(*columns, name)
