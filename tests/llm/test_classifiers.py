import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistride.llm import labelled, quality, queries, terms, toxicity
from epistride.llm.labelled import Sample
from tests.oracle import connect

LABELS = "doc_id long, toxic int, quality int, text string"


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("name, column, folds, held, threshold", [("op4_toxicity", "toxic", 3, 1, 0.7), ("op6_quality", "quality", 5, 0, 0.3)])
def test_held_out_accuracy(spark, name, column, folds, held, threshold):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).collect()
    known = dict(connect(folder).execute(f"SELECT doc_id, {column} FROM labels").fetchall())
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    tested = [r for r in got if r.held_out and r.doc_id in known]
    score, label = np.array([r.score for r in tested]), np.array([known[r.doc_id] for r in tested])
    # Some 270 labels to learn from; the larger tables give above 0.99.
    assert auc(score, label) > 0.85
    assert np.mean([r.predicted == known[r.doc_id] for r in tested]) > 0.9


def test_held_out_labels_are_not_read(spark, table):
    docs = table([(i, "bad word" if i % 2 else "good word", "s") for i in range(60)])
    rows = [(i, i % 2, 1, "x") for i in range(60)]
    turned = [(i, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t, q, x) for i, t, q, x in rows]
    allowed = labelled.folded(F.col("doc_id"), 3) != 1
    a, b = (toxicity.train(docs, spark.createDataFrame(r, LABELS), allowed) for r in (rows, turned))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    features, labels = [], []
    for _ in range(1200):
        has = rng.random(2) < 0.5
        noise = rng.integers(10, 40, 5)
        features.append(np.unique(np.r_[np.flatnonzero(has), noise]).astype(np.uint32))
        labels.append(float(has[0] ^ has[1]))  # neither term alone tells the label
    data = Sample(features, np.array(labels, np.float32), np.ones(1200, np.float32))
    # Neither term is telling by itself, so all may be used.
    model = toxicity.fit(data, epochs=60, evidence=0.0)
    place = model.place

    def z(terms):
        at = place[np.array(terms)]
        v = model.factors[at]
        return model.bias + model.linear[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    assert z([0]) > z([0, 1]) and z([1]) > z([0, 1])
    assert (place >= 0).sum() <= toxicity.TERMS
    assert (toxicity.fit(data).place >= 0).sum() == 0


def test_machine_scores_as_the_formula():
    texts = [b"You utter clown of a moron", b"", b"a fine day", b"clown clown"]
    found = toxicity.distinct_terms(texts)
    used = np.unique(np.concatenate(found))
    rng = np.random.default_rng(1)
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    place[used[::2]] = np.arange(len(used[::2]))
    machine = toxicity.Machine(place, 0.3, rng.normal(size=len(used[::2])), rng.normal(size=(len(used[::2]), 3)))
    want = []
    for f in found:
        at = place[f][place[f] >= 0]
        v = machine.factors[at]
        pairs = sum(v[i] @ v[j] for i in range(len(at)) for j in range(i))
        want.append(1 / (1 + np.exp(-(0.3 + machine.linear[at].sum() + pairs))))
    assert machine(texts) == pytest.approx(want)


def test_regression_scores_as_a_dot_product():
    texts = [b"One two two two !!", b"", b"x"]
    rng = np.random.default_rng(1)
    model = quality.Regression(0.2, rng.normal(size=1 << quality.BITS))
    found = quality.features(texts)
    assert [int(f[0]) for f in found] == [5, 0, 1] and [len(f) - 1 for f in found] == [9, 0, 1]
    want = [0.2 + quality.SCALE * model.weights[f[1:].astype(int)].sum() / max(1, int(f[0])) for f in found]
    assert model(texts) == pytest.approx(1 / (1 + np.exp(-np.array(want))))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, table, module):
    long = "good words here " * 100_000
    docs = table([(1, None, "a"), (2, "", None), (3, "awful bad words", "a"), (3, "awful bad words", "a"), (None, "awful bad words", "b"), (5, long, "b"), (6, "good words here", "b")])
    labels = spark.createDataFrame([(3, 1, 0, "t"), (6, 0, 1, None), (6, 0, 1, None), (5, 1, 1, "x"), (5, 0, 0, "x"), (None, 1, 1, "x"), (2, None, None, "x"), (9, 1, 0, "x")], LABELS)
    for known in (labels, labels.limit(0), labels.filter("doc_id = 3")):
        model = module.train(docs, known)
        got = module.scores(docs, model).collect()
        assert sorted((r.id is None, r.id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 3), (False, 5), (False, 6), (True, 0)]
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.id in (1, 2)}) == 1 and len({r.score for r in got if r.id in (3, None)}) == 1
    assert module.scores(docs.limit(0), model).count() == 0
    assert module.scores(docs, module.train(docs.limit(0), labels)).count() == 7


def test_sample_is_bounded_and_weighed(spark, table):
    docs = table([(i, f"text {i}", "s") for i in range(100)])
    labels = spark.createDataFrame([(i, int(i < 80), 1, "x") for i in range(100)], LABELS)
    data = labelled.sample(docs, labels, "toxic", F.lit(True), toxicity.distinct_terms, rows_per_label=10)
    assert len(data) == 20 and data.labels.sum() == 10
    assert (data.weights * data.labels).sum() / data.weights.sum() == pytest.approx(0.8)


def test_sample_is_bounded_in_bytes_and_repeated_ids_count_once(spark, table):
    docs = table([(i % 100, "many words here " * (1 + i % 100), "s") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(100)], LABELS)
    every = labelled.sample(docs, labels, "toxic", F.lit(True), quality.counted_features)
    assert len(every) == 100 and max(len(f) for f in every.features) == 1 + 2 * 6
    few = labelled.sample(docs, labels, "toxic", F.lit(True), quality.features, bytes_per_label=2000)
    assert 0 < len(few) < 100
    assert all(sum(f.nbytes for f, l in zip(few.features, few.labels) if l == label) <= 2000 for label in (0, 1))
    assert (few.weights * few.labels).sum() / few.weights.sum() == pytest.approx(0.5)


def test_terms_chosen_in_the_tasks_are_those_of_the_whole_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    whole = labelled.sample(docs, labels, "toxic", F.lit(True), toxicity.distinct_terms)
    wanted, got = toxicity.fit(whole), toxicity.train(docs, labels)
    assert (wanted.place == got.place).all() and len(got.linear) > 0
    assert got.bias == wanted.bias and np.allclose(got.linear, wanted.linear) and np.allclose(got.factors, wanted.factors)


def test_null_id_is_in_a_fold(spark, table):
    got = labelled.scored(table([(None, "x", "a")]), lambda texts: np.zeros(len(texts))).select(labelled.folded(F.col("id"), 5) == 0)
    assert got.collect()[0][0] is True


def test_accepted_keeps_columns(spark, table):
    docs = table([(1, "fine", "a"), (2, None, "b")])
    machine = toxicity.Machine(np.full(1 << toxicity.BITS, -1, np.int32), -3.0, np.zeros(0), np.zeros((0, 2)))
    kept = toxicity.accepted(docs, machine)
    assert kept.columns == docs.columns and kept.count() == 2
    assert toxicity.accepted(docs, machine, threshold=0.01).count() == 0


def test_tokens_in_parts_are_the_same():
    text = ("some Words, and more words; " * 50).encode()
    for classes in (terms.LETTERS, terms.LETTERS_AND_MARKS, terms.WORDS):
        whole = terms.Tokens(text, classes)
        split = [terms.Tokens(data, classes).hashes() for data, _, _ in terms.parts([text], classes, 40)]
        assert len(split) > 10 and (np.concatenate(split) == whole.hashes()).all()
