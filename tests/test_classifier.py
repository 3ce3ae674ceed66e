"""The trained scanner: held-out accuracy, the gradient's result, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import classifier
from tessera.operators import guard


def corpus(n):
    rng = random.Random(3)
    mild, rude = "river house light morning letter book walk".split(), "worthless idiot hate stupid".split()
    rows = []
    for i in range(n):
        y = i % 3 == 0
        words = rng.choices(mild, k=rng.randint(5, 25)) + (rng.choices(rude, k=2) if y else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_held_out_accuracy_and_optimum(spark):
    rows = corpus(400) + [(1_000, None, 1), (1_001, "", 0), (1_002, "river", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    train, test = docs.where(~classifier.held_out("doc_id")), docs.where(classifier.held_out("doc_id"))
    model = classifier.fit(classifier.features_of(train, dim=1024), train, dim=1024)
    got = test.join(classifier.scores(classifier.features_of(test, dim=1024), test, model.weights, model.intercept), "doc_id").where("label is not null and text <> ''").collect()
    assert len(got) > 50 and sum((r.score >= 0.5) == (r.label == 1) for r in got) >= 0.95 * len(got)
    # the gradient of the penalised likelihood is about zero there
    w = np.zeros(1025)
    for r in model.weights.collect():
        w[r.idx] = r.w
    w[1024] = model.intercept
    packed = classifier._packed(classifier.features_of(train, dim=1024), train, "doc_id", "label").collect()
    x = np.zeros((len(packed), 1025))
    x[:, 1024] = 1
    for i, r in enumerate(packed):
        x[i, r.at] = r.x
    p = 1 / (1 + np.exp(-x @ w))
    g = x.T @ (p - np.array([r.y for r in packed])) / len(packed)
    g[:1024] += classifier.PENALTY * w[:1024]
    assert np.abs(g).max() < 0.02


def test_one_label_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, "c", 1)], "doc_id bigint, text string, label int")
    model = classifier.fit(classifier.features_of(docs, dim=16), docs, dim=16)
    assert model.weights.count() == 0 and model.intercept > 0
    assert classifier.fit(classifier.features_of(docs.limit(0), dim=16), docs.limit(0), dim=16).intercept == pytest.approx(0.0)


def test_scanner_in_a_verdict(spark):
    df = spark.createDataFrame([("All is well with the answer.", 0.1), ("All is well with the answer.", 0.9), ("All is well with the answer.", None)], "text string, score double")
    v = guard.verdict(df, guard.output_scanners(F.col("text"), bias=classifier.scanner("score")))
    assert sorted((r.score or -1, r.guard_valid, r.guard_reason) for r in v.collect()) == [(-1, False, "Failed scanners: Bias"), (0.1, True, ""), (0.9, False, "Failed scanners: Bias")]
