"""Exact k-NN by pivots and rings against the plain exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, pivots


def table(spark, x, first=0, name="id"):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], f"{name} bigint, embedding array<double>")


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = 4 * np.random.default_rng(0).normal(size=(20, dim))
    return np.round(centres[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, dim)), 2)


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equals_the_plain_search_and_skips_rings(spark, metric, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK_ROWS", 40)
    x = np.vstack([clustered(1_500, 12, 1), np.repeat(clustered(1, 12, 2), 300, axis=0)])  # and a ring of one point
    corpus, queries = table(spark, x), table(spark, clustered(25, 12, 3), 100, "query_id")
    index = pivots.build(corpus, metric=metric)
    assert index.rings.agg(F.max("chunks")).first()[0] > 1
    assert rows(pivots.search(index, queries, 7)) == rows(dense.knn(corpus, queries, 7, metric))
    read = pivots.rings_read(index, queries, 7).agg(F.sum("rows").alias("rows"), F.sum("rows_read").alias("read")).first()
    assert read.read < 0.4 * read.rows


def test_without_structure_it_stays_exact_and_a_saved_index_answers(spark, tmp_path):
    rng = np.random.default_rng(5)
    corpus, queries = table(spark, rng.normal(size=(300, 30))), table(spark, rng.normal(size=(6, 30)), 0, "query_id")
    pivots.build(corpus, str(tmp_path / "index"))
    index = pivots.PivotIndex.load(spark, str(tmp_path / "index"))
    assert rows(pivots.search(index, queries, 400)) == rows(dense.knn(corpus, queries, 400))  # k above the corpus
    assert rows(pivots.search(index, queries, 3)) == rows(dense.knn(corpus, queries, 3))


def test_edge_cases(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id bigint, embedding array<double>")
    assert [r[2] for r in rows(pivots.search(pivots.build(corpus), queries, 1))] == [1]
    assert pivots.search(pivots.build(corpus), queries.limit(0), 1).count() == 0
    with pytest.raises(ValueError):
        pivots.build(corpus.limit(0))
