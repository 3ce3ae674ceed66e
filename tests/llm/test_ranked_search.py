"""Ranked search by NRA against a brute-force scorer."""

import math
import random
import re

import numpy as np
import pytest
from conftest import CLASH

from tessera.llm import nra_search as N

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    docs = [(i, w) for i, t in rows if (w := words(t))]
    n_docs, n_words = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in docs:
            m = 25 + (75 * len(w) * n_docs) // n_words
            score = 0
            for t in words(text):
                if tf := w.count(t):
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, items, k=10):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    for c in CLASH:
        docs, queries = docs.selectExpr("*", f"'x' as {c}"), queries.selectExpr("*", f"'x' as {c}")
    got = N.search(docs, queries, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "a", "house", "été", "ÉTÉ", "日本", "x1", "B2b", "rare"] + [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice([" ", ", ", "_", "\n"]).join(rng.choices(vocabulary, [9] * 5 + [1] * 35, k=rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 8)))) for i in range(12)]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = corpus(150, 1)
    rows += [(1_000, None), (1_001, ""), (1_002, "?!"), (None, "house rare rare"), rows[3], rows[3], (1_003, rows[4][1]),
             (1_004, "the " * 20_000 + "rare"), (1_005, "q" * 50_000)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "the the the house"), (53, "rare"), (None, "été")]
    assert found(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    rows, items = corpus(5, 2)
    assert found(spark, [], items) == [] and found(spark, rows, []) == []
    assert found(spark, [(1, None)], items) == []


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here")] + [(i, "other") for i in range(100, 200)]
    got = found(spark, rows, [(1, "same"), (2, "other words")], k=10)
    assert got == brute(rows, [(1, "same"), (2, "other words")])
    assert [r[2] for r in sorted(got, key=lambda r: (r[0], r[1])) if r[0] == 1] == list(range(1, 11))


def test_small_runs_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    rows, items = corpus(60, 3)
    assert found(spark, rows, items, 4) == brute(rows, items, 4)


@pytest.mark.parametrize("seed", range(6))
def test_bounds_meet_the_exact_scores(seed, monkeypatch):
    """One run, small blocks: all members and ties at the k-th score, with exact scores."""
    monkeypatch.setattr(N, "FIRST_BLOCK", 1 + seed)
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 12, 300)
    terms = np.concatenate([rng.choice(20, s, replace=False) for s in sizes]).astype(np.int64)
    tfs = rng.integers(1, 4, len(terms))
    run = N.Run(np.arange(300), np.zeros(300, bool), rng.integers(25, 60, 300), terms, tfs, sizes)
    query = [(int(t), int(rng.integers(0, 5))) for t in rng.choice(22, 7, replace=False)]
    exact = np.zeros(300, np.int64)
    for t, factor in query:
        a, b = run.list_of(t)
        np.add.at(exact, run.doc[a:b], run.impact[a:b] * factor)
    for cutoff in (0, int(np.sort(exact)[-3])):
        docs, scores = run.best(query, 5, cutoff)
        least = max(np.sort(exact)[-5], cutoff, 1)
        assert set(np.flatnonzero(exact >= least)) <= set(docs) and (exact[docs] == scores).all()
    monkeypatch.setattr(N, "MARKS", 7 * 40)
    found = {}
    for part in run.parts(len(query)):
        docs, scores = part.best(query, 5, 0)
        found |= dict(zip(part.ids[docs].tolist(), scores.tolist(), strict=True))
    assert len(list(run.parts(7))) == 8
    assert {d: exact[d] for d in np.flatnonzero(exact >= max(np.sort(exact)[-5], 1))}.items() <= found.items()
