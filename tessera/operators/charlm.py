"""Character language model as tables (V2): smoothed trigrams fitted on a corpus.

Texts are lower-cased, everything but letters becomes one blank, and a blank
stands at either end. ``fit`` counts trigrams and their first two characters;
``score`` gives the mean log-probability of a text's characters,
``ln((c(abc) + ALPHA) / (c(ab) + ALPHA * V))`` with V the number of distinct
characters: near 0 for text like the corpus, near ``-ln V`` for gibberish. Grams
are counted inside a task (one linear pass, whatever the length of a text), so
only distinct grams of a batch or a text are shuffled; the model is broadcast
only if it is small.

A null text has no score; one without a letter has no grams and scores null."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.guard import result
from tessera.session import fits, materialize

ALPHA = 0.1


def plain(text) -> Column:
    """Lower-case letters, other runs as single blanks, one blank at either end; empty without a letter."""
    t = F.col(text) if isinstance(text, str) else text
    inner = F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}]+", " "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _keys(text: str) -> np.ndarray:
    """One integer for each trigram of a text."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _grams(keys: np.ndarray) -> list[str]:
    low = (1 << 21) - 1
    return [chr(k >> 42) + chr(k >> 21 & low) + chr(k & low) for k in keys.tolist()]


@dataclass
class CharModel:
    grams: DataFrame  # gram, n
    contexts: DataFrame  # ctx, n
    letters: DataFrame  # one row: v


def gram_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n over all texts."""
    def count(batches):
        for batch in batches:
            keys = [_keys(t) for t in batch.column(0).to_pylist()]
            grams, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(_grams(grams), pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    texts = corpus.select(plain(text_col).alias("t")).where("t <> ''")
    return texts.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(corpus: DataFrame, text_col: str = "text") -> CharModel:
    grams = materialize(gram_counts(corpus, text_col), "char-grams")
    contexts = grams.groupBy(F.substring("gram", 1, 2).alias("ctx")).agg(F.sum("n").alias("n"))
    letters = grams.agg(F.countDistinct(F.substring("gram", 3, 1)).alias("v"))
    return CharModel(grams, contexts, letters)


def score(texts: DataFrame, model: CharModel, keys: list[str], text_col: str = "text", digits: int = 6) -> DataFrame:
    """``keys`` and score (null without a letter) of every row of ``texts`` with a text."""
    rows = texts.select(*keys, plain(text_col).alias("t")).where("t is not null")
    names, at = [*keys, "gram", "n"], len(keys)

    def own(batches):
        for batch in batches:
            row, grams, counts = [], [], []
            for i, t in enumerate(batch.column(at).to_pylist()):
                g, n = np.unique(_keys(t), return_counts=True) if t else (np.zeros(0, np.int64),) * 2
                row.append(np.full(len(g), i))
                grams.append(g)
                counts.append(n)
            if row:
                row, grams, counts = (np.concatenate(x) for x in (row, grams, counts))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(row, pa.int64())) for j in range(at)),
                                                  pa.array(_grams(grams), pa.string()), pa.array(counts, pa.int64())], names)

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    own_grams = rows.mapInArrow(own, schema).withColumn("ctx", F.substring("gram", 1, 2))
    grams, contexts = model.grams.withColumnRenamed("n", "c3"), model.contexts.withColumnRenamed("n", "c2")
    if fits(model.grams):
        grams, contexts = F.broadcast(grams), F.broadcast(contexts)
    joined = own_grams.join(grams, "gram", "left").join(contexts, "ctx", "left").crossJoin(F.broadcast(model.letters))  # one row
    p = (F.coalesce("c3", F.lit(0)) + F.lit(ALPHA)) / (F.coalesce("c2", F.lit(0)) + F.lit(ALPHA) * F.greatest("v", F.lit(1)))
    scored = joined.groupBy(*keys).agg(F.round(F.sum(F.col("n") * F.log(p)) / F.sum("n"), digits).alias("score"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    return rows.drop("t").distinct().alias("r").join(scored.alias("s"), match, "left").select(*[F.col(f"r.{k}") for k in keys], "score")


def gibberish(score_col, least: float) -> Column:
    """V2 scanner result from a score: valid from ``least`` on; a text without a score is not."""
    s = F.col(score_col) if isinstance(score_col, str) else score_col
    return result(F.coalesce(s >= least, F.lit(False)), F.coalesce(1.0 - F.exp(s), F.lit(1.0)), F.lit(""))
