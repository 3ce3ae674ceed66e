"""Needles that are whole words take one pass over the texts, however many there are."""

from __future__ import annotations

import random

from tessera.operators import needles


def test_many_words_are_joined_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(needles, "BLOCK", 50)
    monkeypatch.setattr(needles, "RUN_CHARS", 300)
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(400)] + ["𝒜b", "a_1", "日本"]
    texts = [(i, " ".join(rng.choice(words).upper() for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(3, "W1É w1é"), (90, None), (91, ""), (92, "a b.c a")]
    table = [(w,) for w in words] + [("b.c",), ("w1",), (None,), ("",), ("W2É",)]
    found = needles.hits(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(table, "needle string"), "id", mode="word")
    known = {w.lower() for w in words}
    want = sorted((i, w) for i, t in texts if t for w in set(t.lower().split()) & known) + [(92, "b.c")]
    assert sorted((r.id, r.needle) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 2  # the runs, and the one block of needles that are no run
