"""Pairwise relevance scoring and reranking.

The default scorer is lexical and JVM-side: coverage of the query's distinct
words in the whole document, plus half the coverage of its bigrams (a model with
an input limit cuts its own input: ``max_tokens``). A model can replace it: any ``(query_col, doc_col) -> Column``,
including a ``pandas_udf`` (Arrow batches), or a precomputed score table.

Plan shape: candidates are already top-k per query, so the pair table is
bounded by |queries| x k; the document text is joined onto that bounded
side (a size-checked broadcast of the candidates) and tokenised only for
candidate rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bigrams, tokens
from tessera.operators.topk import top_k

PairScorer = Callable[[Column, Column], Column]


def lexical_overlap(query: Column, doc: Column, max_tokens: int | None = None) -> Column:
    """Built-in pair score in [0, 1.5], rounded to 6 digits."""
    qt = F.array_distinct(tokens(query))
    dt = tokens(doc) if max_tokens is None else F.slice(tokens(doc), 1, max_tokens)
    qb = F.array_distinct(bigrams(tokens(query)))
    db = bigrams(dt)
    uni = F.when(F.size(qt) > 0, F.size(F.array_intersect(qt, dt)) / F.size(qt)).otherwise(0.0)
    bi = F.when(F.size(qb) > 0, F.size(F.array_intersect(qb, db)) / F.size(qb)).otherwise(0.0)
    return F.round(uni + F.lit(0.5) * bi, 6)


def add_pair_score(pairs: DataFrame, query_col: str, doc_col: str, out: str = "rerank_score",
                   scorer: PairScorer | None = None,
                   max_tokens: int | None = None) -> DataFrame:
    """Score every (query, doc) pair. The token arrays are projected first so the
    tokenizer runs once per text (see ``text.with_grams``)."""
    if scorer is not None:
        return pairs.withColumn(out, scorer(F.col(query_col), F.col(doc_col)))
    dt = tokens(doc_col) if max_tokens is None else F.slice(tokens(doc_col), 1, max_tokens)
    staged = pairs.select("*", F.array_distinct(tokens(query_col)).alias("_qt"), dt.alias("_dt"),
                          tokens(query_col).alias("_qall"))
    staged = staged.select("*", F.array_distinct(bigrams("_qall")).alias("_qb"),
                           bigrams("_dt").alias("_db"))
    qt, dt, qb, db = (F.col(c) for c in ("_qt", "_dt", "_qb", "_db"))
    uni = F.when(F.size(qt) > 0, F.size(F.array_intersect(qt, dt)) / F.size(qt)).otherwise(0.0)
    bi = F.when(F.size(qb) > 0, F.size(F.array_intersect(qb, db)) / F.size(qb)).otherwise(0.0)
    return staged.withColumn(out, F.round(uni + F.lit(0.5) * bi, 6)).drop(
        "_qt", "_dt", "_qall", "_qb", "_db")


def rerank(cands: DataFrame, k: int | None, qid: str = "query_id", query_col: str = "query",
           doc_col: str = "text", id_col: str = "doc_id", retrieval_rank: str = "rank",
           scorer: PairScorer | None = None, score_col: str = "rerank_score",
           before_rank: list | None = None) -> DataFrame:
    """Order by score desc (NULL scores last, i.e. a failed scorer keeps
    the retrieval order), then ``before_rank`` columns (e.g. source order of a
    fused list), then retrieval rank; keep k when k is truthy."""
    scored = add_pair_score(cands, query_col, doc_col, score_col, scorer)
    if retrieval_rank != "retrieval_rank":
        scored = scored.withColumnRenamed(retrieval_rank, "retrieval_rank")
    order = [F.col(score_col).desc_nulls_last()] + [F.col(c) for c in (before_rank or [])]
    return top_k(scored, qid, order + [F.col("retrieval_rank"), F.col(id_col)], k)
