"""BM25 over slices gives the scores of the formula, without a row per query and document."""

from __future__ import annotations

import math
from collections import Counter

from tessera.operators import lexical

K1, B, EPSILON = 1.5, 0.75, 0.25


def test_scores_and_plan(spark):
    docs = {1: ["a", "b", "a"], 2: ["b"], 3: [], 4: ["c", "a", "\0", "d"], 5: ["b", "c", "\0\0"], 6: ["b", "e"]}
    queries = {1: ["a", "a", "b"], 2: ["\0", "zz"], 3: ["\0\0"], 4: ["zz"], 5: []}
    df = Counter(t for d in docs.values() for t in set(d))
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    idf = {t: math.log((n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    floor = EPSILON * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    want = {}
    for q, ts in queries.items():
        for d, own in docs.items():
            if set(ts) & set(own):
                tf, norm = Counter(own), K1 * (1 - B + B * len(own) / mean)
                want[q, d] = sum(idf[t] * tf[t] * (K1 + 1) / (tf[t] + norm) for t in ts if t in tf)
    got = lexical.bm25_search(spark.createDataFrame(list(docs.items()), "doc_id long, terms array<string>"),
                              spark.createDataFrame(list(queries.items()), "query_id long, q_terms array<string>"), 10, k1=K1, b=B, epsilon=EPSILON)
    rows = {(r.query_id, r.doc_id): r.score for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 2e-6 for k in want)
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString()
