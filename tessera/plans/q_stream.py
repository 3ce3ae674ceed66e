"""Registered streaming, approximate-NN and plug-in scorer queries (ST1, ST2, R6, X1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dense, lexical, rerank
from tessera.plans.q_filters import course_docs
from tessera.plans.q_guard import INPUT_REASON_SQL, input_flags_sql
from tessera.plans.q_lexical import TFIDF_TOPK_SQL
from tessera.plans.q_rerank import course_retrieve_sql
from tessera.plans.registry import register
from tessera.plans.sqlfrag import tfidf_ctes, tokens_sql
from tessera.session import materialize, work_path
from tessera.sources.tables import as_course_queries, benchmark_queries, course_queries_sql, load
from tessera.streaming import ingest
from tessera.streaming import queries as ST


STREAM_K = 5


@register("stream_topk", sql=TFIDF_TOPK_SQL)
def stream_topk(spark, sf_dir):
    """ST1: benchmark items arrive as a file stream; each micro-batch is answered
    against the static document index; equals the batch top-5."""
    idx = lexical.fit_tfidf(load(spark, sf_dir, "documents"), persist=True)
    sink = ST.stream_topk(spark, f"{sf_dir}/benchmark.parquet", idx, 5)
    return spark.read.parquet(sink).select("query_id", "doc_id", "score", "rank")


@register("stream_courses", sql=f"""WITH {course_retrieve_sql(STREAM_K)},
g AS (SELECT query_id, g_ok AND b_ok AND p_ok AND t_ok AS ok, {INPUT_REASON_SQL} AS reason FROM (
  SELECT query_id, {input_flags_sql('query')} FROM {course_queries_sql()}))
SELECT cr.query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS reason FROM cr JOIN g ON g.query_id = cr.query_id WHERE ok
UNION ALL SELECT query_id, NULL, NULL, NULL, reason FROM g WHERE NOT ok""")
def stream_courses(spark, sf_dir):
    """ST1: course questions arrive as a file stream and take the whole path (guard, parts,
    enhancement, search, post-filter); equals the batch path."""
    docs = course_docs(spark, sf_dir)
    index = lexical.fit_tfidf(docs, persist=True)
    sink = ST.stream_courses(spark, f"{sf_dir}/benchmark.parquet", docs, index, STREAM_K, as_course_queries)
    return spark.read.parquet(sink).select("query_id", "doc_id", "score", "rank", "reason")


def landings(spark, sf_dir, sink, key, delay):
    """Events land in four parts by time, each with every seventh event of the part before once
    more (so rows come again, and late), and are ingested as they land: the state carries over."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = e.agg(F.min("ts").cast("double").alias("low"), F.max("ts").cast("double").alias("high"))
    part = F.least(F.floor(4 * (F.col("ts").cast("double") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0))), F.lit(3))
    dealt = materialize(e.crossJoin(F.broadcast(span)).withColumn("part", part).drop("low", "high"), "events-by-part")  # span is one row
    landed = work_path(spark, "events-landed")
    for i in range(4):
        again = dealt.where((F.col("part") == i - 1) & (F.col("event_id") % 7 == 0))
        dealt.where(F.col("part") == i).unionByName(again).drop("part").write.mode("append").parquet(landed)
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(landed)
        ingest.run(stream, sink, key, "ts", delay, lateness="20 days")
    return ingest.ingested(spark, sink, e.schema, delay)


@register("stream_dedupe", sql="SELECT event_id, event_type, value FROM events")
def stream_dedupe(spark, sf_dir):
    """ST2: landings with repeated and late events: every event arrives once."""
    return landings(spark, sf_dir, work_path(spark, "stream-dedupe"), "event_id", "1 hour").select("event_id", "event_type", "value")


@register("stream_ingest", sql="""WITH RECURSIVE kept AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT k.user_id, min(e.ts) AS ts FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts > k.ts + INTERVAL 6 HOUR GROUP BY k.user_id, k.ts)
SELECT user_id, ts FROM kept""")
def stream_ingest(spark, sf_dir):
    """ST2: of each user's events, one in six hours, over the same landings."""
    kept = landings(spark, sf_dir, work_path(spark, "stream-ingest"), "user_id", "6 hours")
    return kept.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("ann_lsh_topk")
def ann_lsh_topk(spark, sf_dir):
    """LSH candidates (bucketed random projections, an equi-join on buckets)
    re-scored exactly; approximate, so no SQL twin (recall is tested)."""
    e = load(spark, sf_dir, "embeddings")
    q = dense.centroids(e, "label").withColumnRenamed("label", "query_id")
    return dense.lsh_knn(e, q, 5, id_col="vec_id").select("query_id", "vec_id", "distance", "rank")


# TOKEN_PATTERN in Python's syntax
PY_TOKEN = r"===\s*\w+\s*===|\w+"


@F.pandas_udf(T.DoubleType())
def unigram_coverage(query: pd.Series, doc: pd.Series) -> pd.Series:
    """Example plug-in pair scorer (X1) as an Arrow-batched pandas UDF: share of the
    query's distinct words found in the document. A query's rows share its word set."""
    words = {q: frozenset(w) for q, w in query.drop_duplicates().fillna("").str.lower().str.findall(PY_TOKEN)
             .set_axis(query.drop_duplicates().fillna("")).items()}
    found = doc.fillna("").str.lower().str.findall(PY_TOKEN)
    hits = [len(words[q].intersection(d)) / len(words[q]) if words[q] else 0.0 for q, d in zip(query.fillna(""), found)]
    return pd.Series(hits, dtype="float64").round(6)


@register("plugin_scorer", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0),
src AS (SELECT r.qid AS query_id, r.doc_id, r.rank AS retrieval_rank,
  list_distinct({tokens_sql('b.text')}) AS qt, {tokens_sql('d.text')} AS dt
  FROM ranked r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 10),
s AS (SELECT *, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, dt)) / len(qt) ELSE 0 END, 6) AS rerank_score FROM src),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank, doc_id) AS rank2 FROM s)
SELECT query_id, doc_id, rerank_score, CAST(rank2 AS INTEGER) AS rank FROM f WHERE rank2 <= 5""")
def plugin_scorer(spark, sf_dir):
    """TF-IDF top-10 reranked to 5 with a user-supplied pandas UDF scorer."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    q = benchmark_queries(spark, sf_dir)
    hits = lexical.search(lexical.fit_tfidf(docs), q, 10)
    cands = hits.join(q, "query_id").join(docs, "doc_id")
    return rerank.rerank(cands, 5, scorer=unigram_coverage).select("query_id", "doc_id", "rerank_score", "rank")
