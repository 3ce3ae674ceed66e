"""The character model against plain counts."""

import math
import random
from collections import Counter

import pytest

from tessera.operators import charlm


def plain(t):
    words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
    return f" {' '.join(words)} " if words else ""


def grams(t):
    p = plain(t)
    return [p[i:i + 3] for i in range(len(p) - 2)]


def test_scores_equal_plain_counts(spark):
    rng = random.Random(1)
    words = "the house and rivers été straße 日本 letters".split()
    corpus = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(50)] + ["", "12 !", None]
    texts = [(1, "the rivers and letters"), (2, "xqzj kwvx zzqj"), (3, None), (4, "..."), (5, "the " * 30_000), (1, "the rivers and letters"), (None, "house")]
    counts = Counter(g for t in corpus if t for g in grams(t))
    contexts, letters = Counter(), {g[2] for g in counts}
    for g, n in counts.items():
        contexts[g[:2]] += n
    model = charlm.fit(spark.createDataFrame([(t,) for t in corpus], "text string"))
    assert {r.gram: r.n for r in model.grams.collect()} == counts
    got = {r.id: r.score for r in charlm.score(spark.createDataFrame(texts, "id int, text string").selectExpr("*", "'x' AS gram2"), model, ["id"]).collect()}
    assert set(got) == {1, 2, 4, 5, None} and got[4] is None
    for i, t in dict(texts).items():
        if t and grams(t) and i != 1:  # a repeated key is scored over all its rows, here the same
            p = [math.log((counts[g] + charlm.ALPHA) / (contexts[g[:2]] + charlm.ALPHA * len(letters))) for g in grams(t)]
            assert got[i] == pytest.approx(sum(p) / len(p), abs=2e-6)
    assert got[2] < -2 < got[1]


def test_scanner_result_and_empty_corpus(spark):
    df = spark.createDataFrame([(-1.0,), (-5.0,), (None,)], "s double").select(charlm.gibberish("s", -2.5).alias("r"))
    assert [r.r.is_valid for r in df.collect()] == [True, False, False]
    model = charlm.fit(spark.createDataFrame([], "text string"))
    got = charlm.score(spark.createDataFrame([(1, "abc")], "id int, text string"), model, ["id"]).collect()
    assert len(got) == 1 and got[0].score == 0.0
