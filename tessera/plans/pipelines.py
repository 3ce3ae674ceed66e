"""Retrieval pipelines as DataFrame functions.

Every function takes whole tables (documents, queries) and returns long
candidate tables ``(query_id, doc_id, ..., rank)``; nothing is per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import COURSE_K, COURSE_LABEL, FINAL_K, REVIEW_K, REVIEW_LABEL
from tessera.operators import dense, filters, lexical, rerank
from tessera.operators.fuse import context_lists, dedupe_best_rank
from tessera.operators.topk import top_k
from tessera.session import DEFAULT_BROADCAST_ROWS, fits, materialize

DIM = 64


def _bounded(queries: DataFrame, per_query: int):
    """Candidate tables are at most |queries| x k rows. Check that bound once on
    the (cheap) query table; return a hint function for the candidate sides."""
    small = fits(queries, max(1, DEFAULT_BROADCAST_ROWS // max(1, per_query)))
    return (lambda df: F.broadcast(df)) if small else (lambda df: df)


def course_retrieve(course_docs: DataFrame, queries: DataFrame, k: int,
                    index: lexical.TfidfIndex | None = None, prefilter: bool = False) -> DataFrame:
    """Parts -> enhanced query -> TF-IDF top-k -> parts post-filter (no refill).

    ``prefilter=True`` applies the parts predicate before ranking instead (Q5 option)."""
    q = queries.withColumn("parts", filters.module_parts("query"))
    q = q.withColumn("enhanced", filters.enhance("query", "parts"))
    idx = index or lexical.fit_tfidf(course_docs)
    b = _bounded(queries, k)
    if prefilter:
        s = lexical.score(idx, q.select("query_id", F.col("enhanced").alias("query")))
        s = s.join(b(q.select("query_id", "parts")), "query_id").join(course_docs, "doc_id")
        s = s.where(filters.parts_match("text", "parts")).where(F.col("score") > 0)
        return top_k(s, "query_id", [F.col("score").desc(), F.col("doc_id")], k).select(
            "query_id", "doc_id", "score", "rank", "text")
    hits = lexical.search(idx, q.select("query_id", F.col("enhanced").alias("query")), k)
    hits = b(hits.join(b(q.select("query_id", "parts")), "query_id"))
    hits = hits.join(course_docs, "doc_id")
    return filters.post_filter(hits, "text", "parts").select("query_id", "doc_id", "score", "rank",
                                                             "text")


def review_retrieve(review_docs: DataFrame, queries: DataFrame, k: int,
                    doc_vectors: DataFrame | None = None, dim: int = DIM) -> DataFrame:
    """R5 on hashed embeddings (cosine): (query_id, doc_id, distance, rank, text)."""
    dv = doc_vectors if doc_vectors is not None else dense.hash_embed(review_docs, "doc_id", "text", dim)
    qv = dense.hash_embed(queries, "query_id", "query", dim)
    hits = dense.knn(dv, qv, k, "cosine", id_col="doc_id")
    return _bounded(queries, k)(hits).join(review_docs, "doc_id").select(
        "query_id", "doc_id", "distance", "rank", "text")


def _with_query(cands: DataFrame, queries: DataFrame) -> DataFrame:
    return cands.join(_bounded(queries, 1)(queries.select("query_id", "query")), "query_id")


def course_pipeline(course_docs, queries, initial_k: int = 10, final_k: int = 5, index=None,
                    scorer=None) -> DataFrame:
    """Retrieve initial_k, rerank to final_k (k clamps to what is there)."""
    c = course_retrieve(course_docs, queries, initial_k, index)
    return rerank.rerank(_with_query(c, queries), final_k, scorer=scorer)


def review_pipeline(review_docs, queries, initial_k: int = 10, final_k: int = 5,
                    doc_vectors=None, scorer=None) -> DataFrame:
    """Dense retrieve initial_k, rerank to final_k."""
    r = review_retrieve(review_docs, queries, initial_k, doc_vectors)
    return rerank.rerank(_with_query(r, queries), final_k, scorer=scorer)


def integrated(course_docs, review_docs, queries, course_k: int = COURSE_K,
               review_k: int = REVIEW_K, final_k: int = FINAL_K, index=None, doc_vectors=None,
               scorer=None) -> DataFrame:
    """Both pipelines (each reranked to final_k), labelled, bag union, rerank to final_k."""
    c = course_pipeline(course_docs, queries, course_k, final_k, index, scorer)
    r = review_pipeline(review_docs, queries, review_k, final_k, doc_vectors, scorer)
    cl = c.select("query_id", "doc_id", F.lit("course").alias("source"), F.lit(0).alias("src_order"),
                  F.col("rank").alias("src_rank"), F.concat(F.lit(COURSE_LABEL), "text").alias("text"))
    rl = r.select("query_id", "doc_id", F.lit("review").alias("source"), F.lit(1).alias("src_order"),
                  F.col("rank").alias("src_rank"), F.concat(F.lit(REVIEW_LABEL), "text").alias("text"))
    fused = cl.unionByName(rl)
    return rerank.rerank(_with_query(fused, queries), final_k, retrieval_rank="src_rank",
                         before_rank=["src_order"], scorer=scorer)


def hybrid(course_docs, queries, lexical_k: int = COURSE_K, dense_k: int = COURSE_K,
           final_k: int = FINAL_K, index=None, scorer=None) -> DataFrame:
    """TF-IDF and dense candidates over the same corpus, deduplicated by doc
    keeping the best rank, then reranked to final_k."""
    lex = course_retrieve(course_docs, queries, lexical_k, index).select(
        "query_id", "doc_id", "rank", F.lit(0).alias("src_order"))
    den = review_retrieve(course_docs, queries, dense_k).select(
        "query_id", "doc_id", "rank", F.lit(1).alias("src_order"))
    both = lex.unionByName(den)
    best = dedupe_best_rank(both, "query_id", "doc_id", ["rank", "src_order"])
    cands = _bounded(queries, lexical_k + dense_k)(best).join(course_docs, "doc_id")
    return rerank.rerank(_with_query(cands, queries), final_k, before_rank=[], scorer=scorer)


def prompts(ranked: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """A9 + P17: per query, the context list in rank order and the user prompt."""
    from tessera.functions.render import prompt
    ctx = context_lists(ranked, "query_id", "rank", text_col)
    return queries.join(ctx, "query_id", "left").select("query_id", "query", "docs",
                                                        prompt("query", "docs").alias("prompt"))


METHODS = ("tfidf", "bm25", "dense")


def retrieve(corpus: DataFrame, queries: DataFrame, k: int, method: str = "tfidf") -> DataFrame:
    """One retrieval entry point, ``(query_id, doc_id, rank, method)`` for any method.
    tfidf = R4 (enhanced query + parts post-filter); bm25 = R14 (section weights,
    post-filter on course/professor/term); dense = hashed-embedding cosine k-NN."""
    if method == "tfidf":
        out = course_retrieve(corpus, queries, k)
    elif method == "bm25":
        q = queries.withColumn("parts", filters.query_parts("query"))
        d = corpus.select("doc_id", lexical.bm25_doc_terms("text").alias("terms"))
        qt = q.select("query_id", lexical.bm25_query_terms("query", "parts").alias("q_terms"))
        hits = lexical.bm25_search(d, qt, k)
        hits = _bounded(queries, k)(hits.join(_bounded(queries, 1)(q.select("query_id", "parts")), "query_id"))
        out = filters.post_filter(hits.join(corpus, "doc_id"), "text", "parts", ("course", "professor", "term"))
    elif method == "dense":
        out = review_retrieve(corpus, queries, k)
    else:
        raise ValueError(f"method must be one of {METHODS}")
    return out.select("query_id", "doc_id", "rank", F.lit(method).alias("method"))


def compare(corpus: DataFrame, queries: DataFrame, k: int, methods=METHODS) -> DataFrame:
    """R15 side-by-side: the union of every method's results, tagged by method. The corpus is
    written once: each method reads it several times, and its texts may be costly to render."""
    corpus = materialize(corpus.select("doc_id", "text"), "compare-corpus")
    res = [retrieve(corpus, queries, k, m) for m in methods]
    out = res[0]
    for r in res[1:]:
        out = out.unionByName(r)
    return out
