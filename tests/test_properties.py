"""Properties of the retrieval operators on the sf0.001 tables."""

import os

from pyspark.sql import functions as F

from tessera.operators import dense, lexical
from tessera.operators.evaluate import _lcs_len, rouge_l
from tessera.sources.tables import benchmark_queries, load

SF = "/root/testdata/sf0.001"


def test_tfidf_norms_and_scores(spark):
    docs = load(spark, SF, "documents")
    idx = lexical.fit_tfidf(docs)
    ss = idx.postings.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    assert ss.agg(F.max(F.abs(F.col("s") - 1.0))).first()[0] < 1e-9
    sc = lexical.score(idx, benchmark_queries(spark, SF))
    assert sc.agg(F.max("score")).first()[0] <= 1 + 1e-9


def test_topk_prefix_monotone_and_partition_independent(spark):
    docs = load(spark, SF, "documents")
    q = benchmark_queries(spark, SF)
    idx = lexical.fit_tfidf(docs)
    k3 = {(r.query_id, r.rank): r.doc_id for r in lexical.search(idx, q, 3).collect()}
    k5 = {(r.query_id, r.rank): r.doc_id for r in lexical.search(idx, q, 5).collect()}
    assert all(k5[key] == v for key, v in k3.items())
    idx2 = lexical.fit_tfidf(docs.repartition(5).orderBy(F.rand(1)))
    k5b = {(r.query_id, r.rank): r.doc_id for r in lexical.search(idx2, q.repartition(3), 5).collect()}
    assert k5 == k5b


def test_dense_knn_matches_brute_force(spark):
    import numpy as np
    e = load(spark, SF, "embeddings")
    q = dense.centroids(e, "label").withColumnRenamed("label", "query_id")
    got = {(r.query_id, r.rank): r.vec_id for r in dense.knn(e, q, 5, "l2", id_col="vec_id").collect()}
    rows = e.collect()
    X = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    for c in q.collect():
        d = np.round(((X - np.array(c.embedding)) ** 2).sum(1), 6)
        order = np.lexsort((ids, d))[:5]
        assert [got[(c.query_id, i + 1)] for i in range(5)] == list(ids[order])


def test_lsh_recall(spark):
    e = load(spark, SF, "embeddings")
    q = dense.centroids(e, "label").withColumnRenamed("label", "query_id")
    exact = {(r.query_id, r.vec_id) for r in dense.knn(e, q, 5, "l2", id_col="vec_id").collect()}
    approx = {(r.query_id, r.vec_id) for r in dense.lsh_knn(e, q, 5, id_col="vec_id").collect()}
    assert len(exact & approx) / len(exact) >= 0.8


def test_rouge_l_brute_force(spark):
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
        return t[-1][-1]
    cases = [("a b c d", "b d"), ("x y", "z"), ("", "a"), ("a a b", "a b a b")]
    for a, b in cases:
        assert _lcs_len(a.split(), b.split()) == brute(a.split(), b.split())
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "k int, c string, r string")
    got = {r.k: r.lcs for r in rouge_l(df, "k", "c", "r").collect()}
    assert got == {i: brute(a.split(), b.split()) for i, (a, b) in enumerate(cases)}


def test_report_dir_source(spark, tmp_path):
    d = tmp_path / "reports"
    d.mkdir()
    (d / "12345.txt").write_text("Course X (Spring 2024)\nInstructor: Ada\nQ: How?\n1\n\nGreat\f"
                                 "Q: Why?\n2\nFine\n")
    (d / "skip.pdf").write_text("ignored")
    from tessera.operators import reports
    out = reports.review_rows(reports.read_report_dir(spark, str(d))).orderBy("page").collect()
    assert [(r.crn, r.instructor, r.question, r.review) for r in out] == [
        ("12345", "Ada", "How?", "Great"), ("12345", "Ada", "Why?", "Fine")]
    assert os.path.exists(d)
