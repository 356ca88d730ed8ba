import random

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm.toxicity import (
    GRADES,
    Model,
    _distinct,
    fit_ordinal,
    ordinal_slopes,
    score_documents,
    severity_grades,
    train,
    word_features,
)

SCHEMA = "doc_id bigint, text string, toxic string, severity int"


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(2)
    rows = []
    for at in range(1200):
        tokens = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(5, 200))]
        bad = draw.random() < 0.2
        if bad:
            for _ in range(draw.randrange(1, 6)):
                tokens.insert(draw.randrange(len(tokens)), draw.choice(["Vile!", "nasty", "GROSS,", "foul"]))
        rows.append((at, " ".join(tokens), int(bad)))
    return rows


def test_held_out_accuracy(spark, labelled):
    documents = spark.createDataFrame([(at, text, None, 0) for at, text, _ in labelled], SCHEMA)
    labels = spark.createDataFrame(
        [(at, toxic) for at, _, toxic in labelled[:800]] + [(3, None), (None, 1), (5000, 1)], "doc_id bigint, toxic int"
    )
    model = train(documents, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = {row.id: row for row in score_documents(documents, model).collect()}
    held_out = [(rows[at], toxic) for at, _, toxic in labelled[800:]]
    assert np.mean([row.toxic == bool(toxic) for row, toxic in held_out]) > 0.97
    assert np.mean([row.toxic for row, toxic in held_out if not toxic]) < 0.01
    worst = [row.severity for row, toxic in held_out if row.grade == GRADES - 1]
    assert worst and min(worst) > 1.5
    again = train(documents, labels)
    assert (again.weights == model.weights).all()


def test_sample_is_bounded(spark, labelled):
    documents = spark.createDataFrame([(at, text, None, 0) for at, text, _ in labelled], SCHEMA)
    labels = spark.createDataFrame([(at, toxic) for at, _, toxic in labelled], "doc_id bigint, toxic int")
    assert (train(documents, labels, sample_rows=0).weights == 0).all()


def test_odd_texts(spark):
    weights = np.zeros(1 << 18)
    owner, feature = word_features(pa.array(["vile"]))
    weights[feature] = 9.0
    model = Model(weights, np.array([2.0, 4.0, 6.0]))
    rows = [(1, None), (None, ""), (2, "VILE " * 10_000), (2, "vile?"), (3, "é\n\n ")]
    got = score_documents(spark.createDataFrame([(a, b, "t", 1) for a, b in rows], SCHEMA), model).collect()
    assert sorted((row.id or 0, row.grade, row.toxic) for row in got) == [
        (0, 0, False), (1, 0, False), (2, 3, True), (2, 3, True), (3, 0, False)
    ]
    assert len({row.severity for row in got if not row.toxic}) == 1


def test_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    documents = spark.createDataFrame([(1, "text", None, 0)], SCHEMA)
    model = train(documents, empty)
    assert len(model.thresholds) == GRADES - 1 and score_documents(documents, model).count() == 1
    assert score_documents(documents.where("false"), model).count() == 0


def test_grades_follow_telling_words():
    toxic = np.array([0] * 50 + [1] * 20)
    texts = ["plain words"] * 50 + ["bad worse worst plain"] * 10 + ["bad plain"] * 10
    owner, feature = _distinct(*word_features(pa.array(texts)))
    grades = severity_grades(toxic, owner, feature)
    assert grades[:50].max() == 0 and set(grades[50:60]) == {3} and set(grades[60:]) == {1}
    model = fit_ordinal(grades, owner, feature)
    assert np.isfinite(model.weights).all()


def test_likelihood_and_gradient_equal_brute_force():
    draw = np.random.default_rng(4)
    rows, used = 60, 7
    present = draw.random((rows, used)) < 0.4
    owner, feature = np.nonzero(present)
    grades = draw.integers(0, GRADES, rows)
    free = draw.normal(0, 0.7, used + GRADES - 1)

    def plain(values):
        edges = [values[used]]
        for gap in values[used + 1 :]:
            edges.append(edges[-1] + np.exp(gap))
        total = 0.1 * sum(w * w for w in values[:used])
        for row, grade in zip(present, grades):
            score = sum(w for w, on in zip(values, row) if on)
            below = [0.0, *(1 / (1 + np.exp(score - edge)) for edge in edges), 1.0]
            total -= np.log(below[grade + 1] - below[grade])
        return total / rows

    loss, slope = ordinal_slopes(free, grades, owner, feature)
    assert abs(loss - plain(free)) < 1e-9
    for at in range(len(free)):
        step = np.eye(len(free))[at] * 1e-5
        assert abs((plain(free + step) - plain(free - step)) / 2e-5 - slope[at]) < 1e-6


def test_repeated_ids_do_not_enlarge_the_sample(spark, labelled):
    rows = [(at, text, None, 0) for at, text, _ in labelled[:300]]
    labels = spark.createDataFrame([(at, toxic) for at, _, toxic in labelled[:300]], "doc_id bigint, toxic int")
    once = train(spark.createDataFrame(rows, SCHEMA), labels)
    often = train(spark.createDataFrame(rows + rows[:50] * 4, SCHEMA), labels)
    assert np.allclose(once.thresholds, often.thresholds)
