import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medledger.llm import quality as Q
from medledger.llm import toxicity as T
from medledger.llm.queries import QUERIES
from tests.llm.cases import none, odd

SF = "/root/testdata/sf0.01"


def area(score, label):
    """Area under the ROC curve."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_pair_of_terms_is_learned():
    """Neither an insult nor a group mention alone is toxic: only factors can tell."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        insult, group = rng.random(2) < 0.5
        terms = [100 + i for i in rng.integers(0, 30, 5)] + [1] * int(insult) + [2] * int(group)
        rows.append(np.unique(np.array(terms, np.int64)))
        labels.append(float(insult and group))
    m = T.train(rows[:1000], np.array(labels[:1000]), epochs=60)
    at = [p[p >= 0] for p in map(m.place, rows[1000:])]
    cut = np.concatenate([[0], np.cumsum([len(a) for a in at])])
    got = T.sigmoid(m.margin(np.concatenate(at), cut)) >= 0.5
    assert (got == np.array(labels[1000:])).mean() > 0.99
    assert m.factors[m.place(np.array([1]))[0]] @ m.factors[m.place(np.array([2]))[0]] > 1


def _scored(machine, *features):
    at = machine.place(np.array(features))
    return float(T.sigmoid(machine.margin(at[at >= 0], np.array([0, (at >= 0).sum()])))[0])


def test_pairs_with_many_weakly_tied_terms_are_learned():
    """An ambiguous insult is toxic beside any of 20 group terms, some of which are too even by themselves to pass ``SCREEN``."""
    rng = np.random.default_rng(0)
    rows, labels, seen = [], [], [0, 0]
    while min(seen) < 3000:
        insult, group = rng.random() < 0.4, np.flatnonzero(rng.random(20) < 0.05)
        label = int(insult and len(group) > 0)
        if seen[label] < 3000:
            seen[label] += 1
            rows.append(np.unique(np.concatenate([1000 + rng.zipf(1.3, 30) % 3000, [1] * int(insult), 10 + group]).astype(np.int64)))
            labels.append(float(label))
    ids, _, strong = T._usual(rows, np.array(labels), T.SCREEN)
    assert not strong[np.searchsorted(ids, np.arange(10, 30))].all()
    m = T.train(rows, np.array(labels))
    assert _scored(m, 1) < T.THRESHOLD
    assert all(_scored(m, 10 + g) < T.THRESHOLD <= _scored(m, 1, 10 + g) for g in range(20))


def _families(size, rng, least=1500):
    """Insults and group terms of two families: toxic together within a family, clean across; a slur is toxic too."""
    rows, labels, kinds, seen = [], [], [], [0, 0]
    while min(seen) < least:
        insult, group = ((rng.integers(2), rng.integers(size)) if rng.random() < 0.5 else None for _ in range(2))
        both = insult is not None and group is not None
        slur = rng.random() < 0.1
        label = int(slur or (both and insult[0] == group[0]))
        if seen[label] >= least:
            continue
        seen[label] += 1
        words = list(1000 + rng.zipf(1.3, 30) % 3000) + [1] * int(slur)
        words += [at + 100 * x[0] + x[1] for at, x in ((100, insult), (300, group)) if x is not None]
        rows.append(np.unique(np.array(words, np.int64)))
        labels.append(float(label))
        kinds.append("slur" if slur else "matched" if label else "crossed" if both else "half")
    return rows, np.array(labels), np.array(kinds)


@pytest.mark.parametrize("size", [3, 10])
def test_pairs_that_no_sum_of_terms_can_tell(size):
    """Every single term is as common in clean as in toxic texts."""
    rows, labels, _ = _families(size, np.random.default_rng(size), 3000)
    m = T.train(rows, labels)
    rows, _, kinds = _families(size, np.random.default_rng(100 + size))
    at = [p[p >= 0] for p in map(m.place, rows)]
    got = T.sigmoid(m.margin(np.concatenate(at), np.concatenate([[0], np.cumsum([len(a) for a in at])])))
    matched, crossed = got[kinds == "matched"], got[kinds == "crossed"]
    assert area(np.concatenate([matched, crossed]), np.repeat([1, 0], [len(matched), len(crossed)])) >= 0.95
    assert (matched >= T.THRESHOLD).mean() >= 0.9 and (got[kinds == "slur"] >= T.THRESHOLD).mean() >= 0.99
    assert (crossed >= T.THRESHOLD).mean() <= 0.05 and (got[kinds == "half"] >= T.THRESHOLD).mean() <= 0.05


def test_any_of_many_insults_with_any_of_many_groups():
    rng = np.random.default_rng(4)

    def draw(least):
        rows, labels, seen = [], [], [0, 0]
        while min(seen) < least:
            has = rng.random(2) < 0.5
            label = int(has.all())
            if seen[label] < least:
                seen[label] += 1
                words = list(1000 + rng.zipf(1.3, 30) % 3000) + [at + rng.integers(60) for at, h in zip((100, 300), has, strict=True) if h]
                rows.append(np.unique(np.array(words, np.int64)))
                labels.append(float(label))
        return rows, np.array(labels)

    m = T.train(*draw(3000))
    rows, labels = draw(1000)
    assert T._wrong(m, rows, labels) < 0.05


def test_score_of_whole_texts_is_the_sum_over_all_terms_and_pairs(spark):
    """``score`` against a plain loop over the terms of whole texts, the longest included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = T.fit(docs, labels.where(~T.held_out(F.col("doc_id"))))
    place = {int(f): k for k, f in enumerate(m.ids)}
    some = docs.orderBy(F.desc("n_chars")).limit(3).union(docs.where("doc_id % 50 = 0"))
    for r in T.score(some.select("doc_id", "text"), m).collect():
        _, feature = T.distinct(*T.terms(pa.array([r["text"]])))
        at = [place[int(f)] for f in feature if int(f) in place]
        total = m.bias + sum(m.weights[k] for k in at)
        for i, a in enumerate(at):
            total += float(np.sum(m.factors[at[:i]] @ m.factors[a])) if i else 0.0
        assert abs(r["score"] - float(T.sigmoid(np.array(total)))) < 1e-6


def test_rare_toxic_only_term_is_learned():
    """Eight documents have a word that no clean one has; most toxic ones are known by another word."""
    texts = [f"note {i // 2 % 50} about item {i // 2 % 70}" + (" dreadfulword" if i < 16 else " commonslur") * (i % 2 == 0) for i in range(1000)]
    row, feature = T.distinct(*T.terms(pa.array(texts)))
    labels = np.array([float(i % 2 == 0) for i in range(1000)])
    m = T.train(np.split(feature, np.searchsorted(row, np.arange(1, 1000))), labels)
    got = m.score(pa.array(["a dreadfulword of item 3", "a commonslur of item 3", "note 7 about item 3"]))
    assert (got[:2] >= T.THRESHOLD).all() and got[2] < 0.5


def test_term_bound_cuts_both_labels_alike(spark):
    """Files sorted by label, and one id on very many rows: the bound takes an equal share of each label."""
    rows = [(i, f"plain words{i % 7} of item {i % 5}") for i in range(60)] + [(i, f"plain words{i % 7} commonslur {i % 5}") for i in range(60, 120)]
    docs = spark.createDataFrame([(0, "plain words0 of item 0")] * 300 + rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="of 120 sampled documents"):
        m = T.fit(docs, labels, max_terms=600)
    got = m.score(pa.array(["some commonslur here", "plain words of item 3"]))
    assert got[0] >= T.THRESHOLD > 0.5 > got[1]


def test_margin_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = T.Machine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, T.RANK)))
    at = np.array([0, 2, 5])
    want = m.bias + m.weights[at].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(at) for b in at[:i])
    assert np.allclose(m.margin(at, np.array([0, 3, 3])), [want, m.bias])


def test_toxicity_on_held_out_labels(spark):
    got = QUERIES["op4_factorization_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    score, label = got["score"].to_numpy(), got["toxic"].to_numpy()
    # Some labels of this small table are of texts without any toxic word.
    assert area(score, label) > 0.85 and (got["predicted"][label == 0] == 0).mean() > 0.97
    assert ((got["predicted"] == 1) == (score >= 0.7)).all()


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    open_ = labels.where(~T.held_out(F.col("doc_id")))
    flipped = open_.union(labels.where(T.held_out(F.col("doc_id"))).withColumn("toxic", 1 - F.col("toxic")))
    a, b = T.fit(docs, open_), T.fit(docs, flipped.where(~T.held_out(F.col("doc_id"))))
    assert (a.ids == b.ids).all() and (a.weights == b.weights).all()


def test_quality_agrees_with_labels_it_never_saw(spark):
    got = QUERIES["op7_weak_label_quality"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert area(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.99
    assert (got["predicted"] == got["quality"]).mean() > 0.98


def test_expectation_maximisation_finds_accuracies():
    """Votes drawn from labellers of known accuracy; the posterior beats a majority."""
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.6, 0.6, 0.6])
    right = rng.random((len(truth), 5)) < accuracy
    vote = np.where(right == truth[:, None], Q.GOOD, Q.BAD)
    vote[rng.random(vote.shape) < 0.2] = Q.ABSTAIN
    patterns, inverse, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    posterior = Q.expectation_maximisation(patterns, counts.astype(float))[inverse.ravel()]
    majority = (vote == Q.GOOD).sum(1) >= (vote == Q.BAD).sum(1)
    assert ((posterior >= 0.5) == truth).mean() > (majority == truth).mean() and ((posterior >= 0.5) == truth).mean() > 0.92


def test_statistics_equal_brute_force():
    texts = ["A b, c! c c | D", "", None, "é%% É", "x x"]
    s = Q.statistics(f := Q.find_words(pa.array(texts)), f.hashes())
    assert s["words"].tolist() == [6, 0, 0, 2, 2] and s["again"].tolist() == [2, 0, 0, 0, 1] and s["distinct"].tolist() == [4, 0, 0, 2, 1]
    assert s["pipes"].tolist() == [1, 0, 0, 0, 0] and s["shouts"].tolist() == [1, 0, 0, 0, 0] and s["odd"].tolist() == [1, 0, 0, 2, 0]
    assert s["upper"].tolist() == [2, 0, 0, 0, 0]


def test_odd_inputs(spark):
    frame = odd(spark)
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (None, 1, 1), (8, None, None), (3, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    machine = T.fit(frame, labels)
    made = T.score(frame, machine)
    assert made.columns == [*frame.columns, "score"] and made.count() == 10
    assert T.score(none(spark), machine).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {x[-1] for x in T.score(frame, T.fit(frame, some)).collect()} == {0.5}
    made = Q.score(frame, Q.fit(frame))
    assert made.columns == [*frame.columns, "score"] and made.count() == 10
    assert all(0 <= x[-1] <= 1 for x in made.collect())
    assert Q.score(none(spark), Q.fit(none(spark))).count() == 0
