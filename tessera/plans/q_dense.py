"""Registered dense-vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import render
from tessera.operators import collection, dense
from tessera.plans.registry import register
from tessera.plans.sqlfrag import grams_cte
from tessera.session import materialize, work_path
from tessera.sources.tables import benchmark_queries, load, reviews

TOPK = 5
DIM = 64


def _centroid_sql() -> str:
    return """cent AS (SELECT label AS query_id, list(v ORDER BY pos) AS q FROM (
    SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""


def _dense_sql(dist: str) -> str:
    return f"""WITH {_centroid_sql()},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT query_id, vec_id, round({dist}, 6) AS distance FROM cent, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {TOPK}"""


L2_SQL = "greatest(list_sum(list_transform(list_zip(x, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 0)"
COS_SQL = "1 - list_dot_product(x, q) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(q, q)))"


def _knn_on_embeddings(spark, sf_dir, metric):
    e = load(spark, sf_dir, "embeddings")
    q = dense.centroids(e, "label").withColumnRenamed("label", "query_id")
    return dense.knn(e, q, TOPK, metric, id_col="vec_id").select("query_id", "vec_id", "distance",
                                                                  "rank")


@register("dense_topk_l2", sql=_dense_sql(L2_SQL))
def dense_topk_l2(spark, sf_dir):
    """Exact squared-L2 5-NN of every label centroid over the vector table."""
    return _knn_on_embeddings(spark, sf_dir, "l2")


@register("dense_topk_cosine", sql=_dense_sql(COS_SQL))
def dense_topk_cosine(spark, sf_dir):
    return _knn_on_embeddings(spark, sf_dir, "cosine")


def hash_features_sql(prefix: str, source: str, id_expr: str, text_expr: str) -> str:
    return f"""{grams_cte(prefix, source, id_expr, text_expr)},
{prefix}_h AS (SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS INTEGER) AS idx,
  (CASE WHEN ('0x' || substr(md5(term), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END) * tf AS v FROM {prefix}_tf),
{prefix}_s AS (SELECT id, idx, CAST(sum(v) AS DOUBLE) AS v FROM {prefix}_h GROUP BY id, idx HAVING sum(v) <> 0),
{prefix}_f AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM {prefix}_s)"""


@register("hash_embed", sql=f"""WITH {hash_features_sql('d', 'documents', 'doc_id', 'text')}
SELECT id AS doc_id, idx, round(value, 6) AS value FROM d_f""")
def hash_embed(spark, sf_dir):
    """R7 built-in embedder on documents, sparse long form."""
    d = load(spark, sf_dir, "documents")
    f = dense.hash_features(d, "doc_id", "text", DIM)
    return f.select("doc_id", "idx", F.round("value", 6).alias("value"))


def review_docs(spark, sf_dir):
    """Review documents (P8) keyed by numeric id."""
    r = reviews(spark, sf_dir)
    return r.select(F.col("crn").cast("long").alias("doc_id"), render.review_text().alias("text"))


def _review_docs_sql():
    from tessera.plans.sql_render import review_text_sql
    from tessera.sources.tables import REVIEWS_SQL
    return f"(SELECT CAST(crn AS BIGINT) AS doc_id, {review_text_sql()} AS text FROM {REVIEWS_SQL})"


REVIEW_DOCS_SQL = _review_docs_sql()


@register("dense_review_topk", sql=f"""WITH rd AS {REVIEW_DOCS_SQL},
{hash_features_sql('d', 'rd', 'doc_id', 'text')},
{hash_features_sql('q', 'benchmark', 'item_id', 'text')},
s AS (SELECT q_f.id AS query_id, d_f.id AS doc_id, round(1 - sum(q_f.value * d_f.value), 6) AS distance
  FROM q_f JOIN d_f USING (idx) GROUP BY q_f.id, d_f.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM s)
SELECT query_id, doc_id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOPK}""")
def dense_review_topk(spark, sf_dir):
    """R11 retrieval half: hashed embeddings of review documents vs benchmark items, cosine."""
    docs = dense.hash_embed(review_docs(spark, sf_dir), "doc_id", "text", DIM)
    qs = dense.hash_embed(benchmark_queries(spark, sf_dir), "query_id", "query", DIM)
    return dense.knn(docs, qs, TOPK, "cosine", id_col="doc_id").select(
        "query_id", "doc_id", "distance", "rank")


UPSERT_SQL = f"""WITH {hash_features_sql('d', 'documents', 'doc_id', 'text')},
{hash_features_sql('b', 'benchmark', 'item_id', 'text')},
dn AS (SELECT id, sum(sign(value) * (idx + 1)) AS v FROM d_f GROUP BY id), bn AS (SELECT id, sum(sign(value) * (idx + 1)) AS v FROM b_f GROUP BY id)
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS BIGINT) AS idx, length(text) AS n_chars, CAST(coalesce(v, 0) AS BIGINT) AS vector_signs
FROM documents LEFT JOIN dn ON dn.id = doc_id
UNION ALL
SELECT 'b' || CAST(item_id AS VARCHAR), CAST(item_id AS BIGINT), length(text), CAST(coalesce(v, 0) AS BIGINT) FROM benchmark LEFT JOIN bn ON bn.id = item_id"""


@register("vector_upsert", sql=UPSERT_SQL)
def vector_upsert(spark, sf_dir):
    """R8 + K2 + S6: build a collection from the review documents, then add the
    same rows again (skipped: ids exist) plus the benchmark items (new ids)."""
    path = work_path(spark, "collection")
    docs = load(spark, sf_dir, "documents")
    emb = dense.hash_embed(docs, "doc_id", "text", DIM)
    rows = materialize(docs.select("doc_id", "text").join(emb, "doc_id", "left"), "collection-rows")  # both adds read it
    first = dense.collection_rows(rows, "doc_id", "text", "embedding")
    dense.add_to_collection(path, first)
    dense.add_to_collection(path, first)  # idempotent: nothing new
    b = load(spark, sf_dir, "benchmark")
    bemb = dense.hash_embed(b, "item_id", "text", DIM)
    second = (dense.collection_rows(b.join(bemb, "item_id", "left"), "item_id", "text", "embedding")
              .withColumn("id", F.concat(F.lit("b"), F.col("id"))))
    dense.add_to_collection(path, second)
    return _collection_digest(dense.read_collection(spark, path))


def _collection_digest(coll):
    # a position-weighted sum of the components' signs stands for the stored vector
    weighted = F.aggregate(F.transform("embedding", lambda x, i: F.signum(x.cast("double")) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return coll.select("id", F.col("metadata.index").alias("idx"), F.length("text").cast("long").alias("n_chars"),
                       F.coalesce(weighted, F.lit(0.0)).cast("bigint").alias("vector_signs"))


@register("vector_upsert_bucketed", sql=UPSERT_SQL)
def vector_upsert_bucketed(spark, sf_dir):
    """R8 + K2 + S6: the same collection as a bucketed table: something else is there before and is
    dropped, the review documents are added twice (skipped), the benchmark items and the documents once more."""
    path = work_path(spark, "bucketed-collection")
    docs, b = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    emb, bemb = dense.hash_embed(docs, "doc_id", "text", DIM), dense.hash_embed(b, "item_id", "text", DIM)
    items = dense.collection_rows(b.join(bemb, "item_id", "left"), "item_id", "text", "embedding")
    old = collection.open_collection(spark, path)
    collection.add(spark, old, items)
    rows = materialize(dense.collection_rows(docs.select("doc_id", "text").join(emb, "doc_id", "left"), "doc_id", "text", "embedding"), "collection-rows")
    spark.sql(f"DROP TABLE {old}")
    name = collection.open_collection(spark, path, recreate=True)
    collection.add(spark, name, rows)
    collection.add(spark, name, rows)
    collection.add(spark, name, items.withColumn("id", F.concat(F.lit("b"), F.col("id"))).unionByName(rows))
    return _collection_digest(spark.table(name))
