"""Trained text scanners (V3, V6): logistic regression on hashed features.

Features are the signed, hashed 1- and 2-grams of ``dense.hash_features`` (one
row for each document and bucket). ``fit`` packs the labelled documents once and
then runs full-batch rounds: a task adds up the gradient of its rows, sums per
bucket are combined by Spark, and the driver sees ``dim`` numbers a round,
whatever the number of documents. ``scores`` is a join of features with a table
of weights, so weights from anywhere else do as well."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dense import hash_features
from tessera.operators.guard import result
from tessera.session import fits, materialize

#: Buckets, rounds, and strength of the penalty on weights (per document).
DIM, ROUNDS, PENALTY = 1 << 12, 40, 1e-4


def held_out(id_col: str, folds: int = 5) -> Column:
    """A fifth of the ids, by their hash; null ids train."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


@dataclass
class Linear:
    """weights (idx, w) of buckets and an intercept."""

    weights: DataFrame
    intercept: float


def _packed(features: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """y, at, x: the label, buckets and values of every labelled document (one without grams has none)."""
    arrays = features.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("f"))  # DIM entries at most
    rows = labels.select(id_col, F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull()).join(arrays, id_col, "left")
    return rows.select("y", F.coalesce(F.transform("f", lambda e: e["idx"]), F.array().cast("array<int>")).alias("at"),
                       F.coalesce(F.transform("f", lambda e: e["value"]), F.array().cast("array<double>")).alias("x"))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "label", dim: int = DIM, rounds: int = ROUNDS,
        penalty: float = PENALTY) -> Linear:
    """Weights for labels 0 and 1; without both labels the constant log-odds of what there is."""
    spark = features.sparkSession
    rows = materialize(_packed(features, labels, id_col, label_col), "labelled")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
    n, ones = total["n"], total["ones"] or 0.0
    w = np.zeros(dim + 1)
    w[dim] = np.log((ones + 0.5) / (n - ones + 0.5))
    if 0 < ones < n:
        before, last, best, least = None, None, w, np.inf
        for _ in range(rounds):
            shipped = spark.sparkContext.broadcast(w)  # DIM numbers

            def gradient(batches, shipped=shipped):
                w = shipped.value
                g = np.zeros(dim + 1)
                for batch in batches:
                    y, at, x = batch.column(0).to_numpy(), batch.column(1), batch.column(2).flatten().to_numpy()
                    row = np.repeat(np.arange(len(y)), np.diff(at.offsets.to_numpy()))
                    at = at.flatten().to_numpy()
                    wrong = 1.0 / (1.0 + np.exp(-(np.bincount(row, x * w[at], len(y)) + w[dim]))) - y
                    g[:dim] += np.bincount(at, x * wrong[row], dim)
                    g[dim] += wrong.sum()
                some = np.flatnonzero(g)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(g[some])], ["idx", "g"])

            g = np.zeros(dim + 1)
            summed = rows.mapInArrow(gradient, "idx int, g double").groupBy("idx").agg(F.sum("g").alias("g"))
            for r in summed.collect():  # DIM + 1 rows at most
                g[r["idx"]] = r["g"] / n
            g[:dim] += penalty * w[:dim]
            if (size := float(np.abs(g).max())) < least:
                best, least = w, size
            # Barzilai-Borwein steps: curvature from the change of the gradient; they don't descend
            # in every round, so the flattest point counts
            step = 4.0
            if before is not None:
                dw, dg = w - before, g - last
                step = float(np.clip((dw @ dw) / max(dw @ dg, 1e-12), 0.1, 200.0))
            before, last = w, g
            w = w - step * g
        w = best
    weights = spark.createDataFrame([(int(i), float(w[i])) for i in np.flatnonzero(w[:dim])], "idx int, w double")
    return Linear(weights, float(w[dim]))


def scores(features: DataFrame, docs: DataFrame, weights: DataFrame, intercept: float | Column, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """id, score: the probability of label 1 of every row of ``docs`` (ids as they come)."""
    small = fits(weights)
    margin = features.join(F.broadcast(weights) if small else weights, "idx").groupBy(id_col).agg(F.sum(F.col("value") * F.col("w")).alias("m"))
    start = F.lit(intercept) if isinstance(intercept, (int, float)) else intercept
    p = 1.0 / (1.0 + F.exp(-(F.coalesce("m", F.lit(0.0)) + start)))
    return docs.select(id_col).join(margin, id_col, "left").select(id_col, F.round(p, digits).alias("score"))


def features_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    return hash_features(docs.where(F.col(text_col).isNotNull()), id_col, text_col, dim)


def scanner(score_col, threshold: float = 0.5) -> Column:
    """A scanner result from a probability: valid below ``threshold``; no score is not valid."""
    s = F.col(score_col) if isinstance(score_col, str) else score_col
    return result(F.coalesce(s < threshold, F.lit(False)), F.coalesce(s, F.lit(1.0)), F.lit(""))
