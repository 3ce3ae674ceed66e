"""The sliced term counts behind the TF-IDF index and the hashed embedder."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import dense, lexical


def table(rows):
    return pa.RecordBatch.from_pylist([{"id": i, "t": t} for i, t in rows], schema=pa.schema([("id", pa.int64()), ("t", pa.list_(pa.string()))]))


@pytest.mark.parametrize("limit", [1, 5, 1_000])
def test_slices_keep_an_id_whole_and_count_all(monkeypatch, limit):
    monkeypatch.setattr(lexical, "SLICE_GRAMS", limit)
    rng = np.random.default_rng(3)
    rows = sorted((int(i), [f"w{w}" for w in rng.integers(0, 4, rng.integers(0, 6))]) for i in rng.integers(0, 9, 30))
    rows.append((9, None))
    seen, got = set(), Counter()
    for t in lexical.sliced(iter([table(rows[:7]), table(rows[7:8]), table(rows[8:])]), 2):
        ids, terms, term, doc, tf = lexical.counted(t, 2)
        assert not seen & set(ids.to_pylist())
        seen |= set(ids.to_pylist())
        got.update({(ids[d].as_py(), terms[g].as_py()): int(n) for g, d, n in zip(term, doc, tf, strict=True)})
    want = Counter()
    for i, ws in rows:
        ws = ws or []
        want.update((i, g) for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)])
    assert seen == {i for i, _ in rows} and got == want


def test_index_has_a_row_a_term_and_slice_and_searches_like_all_pairs(spark):
    """A term's documents meet as one row a slice, not one a document; the k best of the slices are those of all pairs."""
    docs = spark.createDataFrame([(i, f"common word{i % 5} item{i % 7} " + "rare " * (i % 3)) for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string")
    index = lexical.fit_tfidf(docs)
    slices = index.stored.select("slice").distinct().count()
    assert index.stored.where("term = 'common'").count() <= slices < 60
    queries = spark.createDataFrame([(1, "common word1 rare"), (2, "item3 unknown"), (3, "unknown"), (4, None)], "query_id long, query string")
    pairs = [(r.query_id, r.doc_id, r.score) for r in lexical.score(index, queries).collect()]
    want = {(q, d, s) for q in (1, 2) for _, d, s in sorted((-s, d, s) for a, d, s in pairs if a == q)[:4]}
    assert {(r.query_id, r.doc_id, r.score) for r in lexical.search(index, queries, 4).collect()} == want


def test_hash_vectors_sum_all_grams_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "c"), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.idx): r.value for r in dense.hash_features(docs, "doc_id", "text", 16).collect()}
    import hashlib
    v = Counter()
    for g, n in {"a": 2, "b": 1, "c": 1, "a b": 1, "b a": 1}.items():
        h = hashlib.md5(g.encode()).hexdigest()
        v[int(h[:8], 16) % 16] += n if int(h[8], 16) % 2 == 0 else -n
    norm = sum(x * x for x in v.values()) ** 0.5
    assert got == pytest.approx({(1, i): x / norm for i, x in v.items() if x})
    assert [r.doc_id for r in dense.hash_embed(docs, "doc_id", "text", 16).collect()] == [1]
