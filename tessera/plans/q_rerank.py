"""Registered rerank and pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import COURSE_K, COURSE_LABEL, FINAL_K, REVIEW_K, REVIEW_LABEL
from tessera.operators import lexical, rerank
from tessera.plans import pipelines
from tessera.plans.q_dense import REVIEW_DOCS_SQL, hash_features_sql, review_docs
from tessera.plans.q_filters import COURSE_DOCS_SQL, course_docs, enhanced_q_sql
from tessera.plans.registry import register
from tessera.plans.sqlfrag import bigrams_sql, sq, tfidf_ctes, tokens_sql
from tessera.sources.tables import benchmark_queries, course_queries, course_queries_sql, load

CQ = course_queries_sql()


def course_retrieve_sql(k: int, q_sql: str = CQ) -> str:
    """CTEs ending in cr(query_id, doc_id, score, rank, text)."""
    return f"""eq AS {enhanced_q_sql(q_sql)}, cd AS {COURSE_DOCS_SQL},
{tfidf_ctes('cd', 'doc_id', 'text', 'eq', 'query_id', 'query')},
c_ranked AS (SELECT qid, doc_id, score,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0),
cr AS (SELECT r.qid AS query_id, r.doc_id, r.score, r.rank, cd.text
  FROM c_ranked r JOIN eq ON eq.query_id = r.qid JOIN cd ON cd.doc_id = r.doc_id
  WHERE r.rank <= {k}
    AND (p_course IS NULL OR contains(lower(cd.text), p_course))
    AND (p_term IS NULL OR contains(lower(cd.text), p_term))
    AND (p_campus IS NULL OR contains(lower(cd.text), p_campus)))"""


def review_retrieve_sql(name: str, k: int, docs_sql: str, q_sql: str, p: str) -> str:
    """CTEs ending in {name}(query_id, doc_id, distance, rank, text)."""
    return f"""{p}docs AS {docs_sql},
{hash_features_sql(p + 'd', p + 'docs', 'doc_id', 'text')},
{hash_features_sql(p + 'q', q_sql, 'query_id', 'query')},
{p}s AS (SELECT {p}q_f.id AS query_id, {p}d_f.id AS doc_id,
  round(1 - sum({p}q_f.value * {p}d_f.value), 6) AS distance
  FROM {p}q_f JOIN {p}d_f USING (idx) GROUP BY {p}q_f.id, {p}d_f.id),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM {p}s),
{name} AS (SELECT r.query_id, r.doc_id, r.distance, r.rank, d.text FROM {p}r r
  JOIN {p}docs d ON d.doc_id = r.doc_id WHERE r.rank <= {k})"""


def rerank_sql(name: str, src: str, extra_order: str = "") -> str:
    """CTEs ending in {name}(... , rerank_score, rank2) from src(query_id, doc_id, query, text, retrieval_rank)."""
    qa, dt = tokens_sql("query"), tokens_sql("text")
    return f"""{name}_t AS (SELECT *, list_distinct({qa}) AS _qt, {dt} AS _dt,
  {qa} AS _qa FROM {src}),
{name}_u AS (SELECT *, list_distinct({bigrams_sql('_qa')}) AS _qb, {bigrams_sql('_dt')} AS _db FROM {name}_t),
{name}_s AS (SELECT * EXCLUDE (_qt, _dt, _qa, _qb, _db), round(
  (CASE WHEN len(_qt) > 0 THEN len(list_intersect(_qt, _dt)) / len(_qt) ELSE 0 END)
  + 0.5 * (CASE WHEN len(_qb) > 0 THEN len(list_intersect(_qb, _db)) / len(_qb) ELSE 0 END), 6) AS rerank_score
  FROM {name}_u),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY rerank_score DESC, {extra_order} retrieval_rank, doc_id) AS rank2 FROM {name}_s)"""


LEX_K, LEX_FINAL = 10, 5


@register("lexical_rerank", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0),
src AS (SELECT r.qid AS query_id, r.doc_id, r.rank AS retrieval_rank, b.text AS query, d.text
  FROM ranked r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.doc_id
  WHERE r.rank <= {LEX_K}),
{rerank_sql('rr', 'src')}
SELECT query_id, doc_id, rerank_score, CAST(retrieval_rank AS INTEGER) AS retrieval_rank,
  CAST(rank2 AS INTEGER) AS rank FROM rr WHERE rank2 <= {LEX_FINAL}""")
def lexical_rerank(spark, sf_dir):
    """R9 + T2: TF-IDF top-10 per benchmark item, reranked to 5 by the built-in pair scorer."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    q = benchmark_queries(spark, sf_dir)
    hits = lexical.search(lexical.fit_tfidf(docs), q, LEX_K)
    cands = hits.join(q, "query_id").join(docs, "doc_id")
    return rerank.rerank(cands, LEX_FINAL).select("query_id", "doc_id", "rerank_score",
                                                  "retrieval_rank", "rank")


CP_INITIAL, CP_FINAL = 10, 5


@register("course_pipeline", sql=f"""
WITH {course_retrieve_sql(CP_INITIAL)},
src AS (SELECT cr.query_id, cr.doc_id, cr.rank AS retrieval_rank, q.query, cr.text
  FROM cr JOIN {CQ} q ON q.query_id = cr.query_id),
{rerank_sql('rr', 'src')}
SELECT query_id, doc_id, rerank_score, CAST(rank2 AS INTEGER) AS rank FROM rr WHERE rank2 <= {CP_FINAL}""")
def course_pipeline(spark, sf_dir):
    """R10 on course documents with the course question set."""
    res = pipelines.course_pipeline(course_docs(spark, sf_dir), course_queries(spark, sf_dir),
                                    CP_INITIAL, CP_FINAL)
    return res.select("query_id", "doc_id", "rerank_score", "rank")


@register("review_pipeline", sql=f"""
WITH {review_retrieve_sql('rv', CP_INITIAL, REVIEW_DOCS_SQL, CQ, 'v')},
src AS (SELECT rv.query_id, rv.doc_id, rv.rank AS retrieval_rank, q.query, rv.text
  FROM rv JOIN {CQ} q ON q.query_id = rv.query_id),
{rerank_sql('rr', 'src')}
SELECT query_id, doc_id, rerank_score, CAST(rank2 AS INTEGER) AS rank FROM rr WHERE rank2 <= {CP_FINAL}""")
def review_pipeline(spark, sf_dir):
    """R11 on review documents (hashed embeddings) with the course question set."""
    res = pipelines.review_pipeline(review_docs(spark, sf_dir), course_queries(spark, sf_dir),
                                    CP_INITIAL, CP_FINAL)
    return res.select("query_id", "doc_id", "rerank_score", "rank")


def integrated_sql(q_sql: str) -> str:
    """CTEs ending in fr(query_id, doc_id, source, text, rerank_score, rank2)."""
    return f"""{course_retrieve_sql(COURSE_K, q_sql)},
{review_retrieve_sql('rv', REVIEW_K, REVIEW_DOCS_SQL, q_sql, 'v')},
c_src AS (SELECT cr.query_id, cr.doc_id, cr.rank AS retrieval_rank, q.query, cr.text
  FROM cr JOIN {q_sql} q ON q.query_id = cr.query_id),
{rerank_sql('crr', 'c_src')},
r_src AS (SELECT rv.query_id, rv.doc_id, rv.rank AS retrieval_rank, q.query, rv.text
  FROM rv JOIN {q_sql} q ON q.query_id = rv.query_id),
{rerank_sql('rrr', 'r_src')},
fused AS (
  SELECT query_id, doc_id, 'course' AS source, 0 AS src_order, rank2 AS retrieval_rank, query,
    {sq(COURSE_LABEL)} || text AS text FROM crr WHERE rank2 <= {FINAL_K}
  UNION ALL
  SELECT query_id, doc_id, 'review', 1, rank2, query, {sq(REVIEW_LABEL)} || text FROM rrr WHERE rank2 <= {FINAL_K}),
{rerank_sql('fr', 'fused', 'src_order,')}"""


@register("integrated_topk", sql=f"""
WITH {integrated_sql(CQ)}
SELECT query_id, source, doc_id, rerank_score, CAST(rank2 AS INTEGER) AS rank FROM fr WHERE rank2 <= {FINAL_K}""")
def integrated_topk(spark, sf_dir):
    """Course (15 -> 10) and review (15 -> 10) candidates, labelled, fused, reranked to 10."""
    res = pipelines.integrated(course_docs(spark, sf_dir), review_docs(spark, sf_dir),
                               course_queries(spark, sf_dir))
    return res.select("query_id", "source", "doc_id", "rerank_score", "rank")


@register("hybrid_topk", sql=f"""
WITH {course_retrieve_sql(COURSE_K)},
{review_retrieve_sql('dv', COURSE_K, COURSE_DOCS_SQL, CQ, 'h')},
both_ AS (SELECT query_id, doc_id, rank, 0 AS src_order FROM cr
  UNION ALL SELECT query_id, doc_id, rank, 1 FROM dv),
best AS (SELECT query_id, doc_id, min({{'rank': rank, 'src_order': src_order}}) AS b FROM both_
  GROUP BY query_id, doc_id),
src AS (SELECT best.query_id, best.doc_id, b.rank AS retrieval_rank, q.query, d.text
  FROM best JOIN {CQ} q ON q.query_id = best.query_id JOIN hdocs d ON d.doc_id = best.doc_id),
{rerank_sql('rr', 'src')}
SELECT query_id, doc_id, rerank_score, CAST(rank2 AS INTEGER) AS rank FROM rr WHERE rank2 <= {FINAL_K}""")
def hybrid_topk(spark, sf_dir):
    """TF-IDF and dense candidates over course documents, deduplicated, reranked."""
    res = pipelines.hybrid(course_docs(spark, sf_dir), course_queries(spark, sf_dir))
    return res.select("query_id", "doc_id", "rerank_score", "rank")


@register("rag_prompts", sql=f"""
WITH {integrated_sql(CQ)},
ctx AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank2) AS context, count(*) AS n
  FROM fr WHERE rank2 <= {FINAL_K} GROUP BY query_id)
SELECT q.query_id, CAST(coalesce(n, 0) AS INTEGER) AS n_docs,
  CASE WHEN n > 0 THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Query: ' || q.query
    || chr(10) || chr(10) || 'Answer:' ELSE 'Query: ' || q.query || chr(10) || chr(10) || 'Answer:' END AS prompt
FROM {CQ} q LEFT JOIN ctx ON ctx.query_id = q.query_id""")
def rag_prompts(spark, sf_dir):
    """R12 + A9 + P17: the user prompt per question over the fused, reranked context."""
    q = course_queries(spark, sf_dir)
    res = pipelines.integrated(course_docs(spark, sf_dir), review_docs(spark, sf_dir), q)
    p = pipelines.prompts(res, q)
    return p.select("query_id", F.size(F.coalesce("docs", F.array().cast("array<string>"))).cast("int").alias("n_docs"),
                    "prompt")
