"""Registered searches with vector indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ann, dense, pivots
from tessera.plans.q_dense import COS_SQL, L2_SQL, TOPK, _dense_sql
from tessera.plans.registry import register
from tessera.session import materialize
from tessera.sources.tables import load


def vectors_and_queries(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e, materialize(dense.centroids(e, "label").withColumnRenamed("label", "query_id"), "centroids")


@register("ann_ivfpq_topk")
def ann_ivfpq_topk(spark, sf_dir):
    """Inverted file with product quantisation over all vectors, searched with every label's
    centroid (approximate, so no SQL twin; ``ann_recall`` holds it against the exact search)."""
    e, q = vectors_and_queries(spark, sf_dir)
    return ann.search(ann.build(e, id_col="vec_id"), q, TOPK).select("query_id", "vec_id", "distance", "rank")


@register("ann_recall", sql=f"""WITH exact AS ({_dense_sql(L2_SQL)})
SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, count(*) >= 0.9 * count(*) AS recalled FROM exact""")
def ann_recall(spark, sf_dir):
    """Exact neighbours of every label's centroid, and whether the index finds at least nine of ten of them."""
    e, q = vectors_and_queries(spark, sf_dir)
    exact = dense.knn(e, q, TOPK, "l2", id_col="vec_id")
    found = ann.search(ann.build(e, id_col="vec_id"), q, TOPK)
    per_query = ann.recall(found, exact, id_col="vec_id")
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.sum("neighbours").alias("neighbours"),
                         (F.sum("hits") >= 0.9 * F.sum("neighbours")).alias("recalled"))


@register("dense_topk_l2_pivots", sql=_dense_sql(L2_SQL))
def dense_topk_l2_pivots(spark, sf_dir):
    """Exact neighbours by pivots and rings; equals ``dense_topk_l2``."""
    e, q = vectors_and_queries(spark, sf_dir)
    return pivots.search(pivots.build(e, id_col="vec_id"), q, TOPK).select("query_id", "vec_id", "distance", "rank")


@register("dense_topk_cosine_pivots", sql=_dense_sql(COS_SQL))
def dense_topk_cosine_pivots(spark, sf_dir):
    """The same by cosine; equals ``dense_topk_cosine``."""
    e, q = vectors_and_queries(spark, sf_dir)
    return pivots.search(pivots.build(e, id_col="vec_id", metric="cosine"), q, TOPK).select("query_id", "vec_id", "distance", "rank")


@register("pivot_rings")
def pivot_rings(spark, sf_dir):
    """Rings and rows read for the nearest neighbours of every label's centroid (no SQL twin: it depends on the pivots)."""
    e, q = vectors_and_queries(spark, sf_dir)
    return pivots.rings_read(pivots.build(e, id_col="vec_id"), q, TOPK)
