"""Registered lexical queries (R1-R4, A1-A3, J3, W2, T1, T4) on documents x benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import lexical
from tessera.plans.registry import register
from tessera.plans.sqlfrag import tfidf_ctes, tokens_sql
from tessera.sources.tables import benchmark_queries, load

TOPK = 5


def _index(spark, sf_dir):
    return lexical.fit_tfidf(load(spark, sf_dir, "documents"), "doc_id", "text")


@register("tokenize_counts", sql=f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct_tokens FROM t""")
def tokenize_counts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    t = tokens("text")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                    F.size(F.array_distinct(t)).cast("long").alias("n_distinct_tokens"))


@register("tfidf_vocab", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text')}
SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM vocab""")
def tfidf_vocab(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.vocab.select("term", F.col("df").cast("long").alias("df"),
                            F.round("idf", 6).alias("idf"))


@register("tfidf_norms", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text')}
SELECT id AS doc_id, round(norm, 6) AS norm, CAST(n_terms AS BIGINT) AS n_terms FROM dn""")
def tfidf_norms(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.norms.select("doc_id", F.round("norm", 6).alias("norm"),
                            F.col("n_terms").cast("long").alias("n_terms"))


TFIDF_TOPK_SQL = f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
ranked AS (SELECT qid AS query_id, doc_id, score,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {TOPK}"""


@register("tfidf_topk", sql=TFIDF_TOPK_SQL)
def tfidf_topk(spark, sf_dir, k: int = TOPK):
    idx = _index(spark, sf_dir)
    res = lexical.search(idx, benchmark_queries(spark, sf_dir), k)
    return res.select("query_id", "doc_id", "score", "rank")
