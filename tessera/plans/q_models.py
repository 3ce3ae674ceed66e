"""Registered fitted guards (V2, V3, V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import charlm, classifier, guard
from tessera.plans.q_dense import DIM, hash_features_sql
from tessera.plans.registry import register
from tessera.session import materialize
from tessera.sources.tables import load


def _plain_sql(table: str, keys: str) -> str:
    return f"""(SELECT {keys}, CASE WHEN p = '' THEN '' ELSE ' ' || p || ' ' END AS t FROM (
  SELECT {keys}, trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) AS p FROM {table} WHERE text IS NOT NULL))"""


def _grams_sql(table: str, keys: str) -> str:
    """Trigrams of each row, by position (a linear pass over its characters)."""
    first = keys.split(",")[0]
    return f"""(SELECT {keys}, a || b || c AS gram FROM (SELECT {keys}, row, ch AS a, lead(ch) OVER w AS b, lead(ch, 2) OVER w AS c FROM (
  SELECT {keys}, row, unnest(chars) AS ch, generate_subscripts(chars, 1) AS pos FROM (
    SELECT {keys}, row_number() OVER (ORDER BY {first}) AS row, string_split(t, '') AS chars FROM {_plain_sql(table, keys)} WHERE t <> ''))
  WINDOW w AS (PARTITION BY row ORDER BY pos)) WHERE c IS NOT NULL)"""


@register("char_grams", sql=f"SELECT gram, count(*) AS n FROM {_grams_sql('documents', 'doc_id')} GROUP BY gram")
def char_grams(spark, sf_dir):
    """V2: trigram counts of all documents."""
    return charlm.gram_counts(load(spark, sf_dir, "documents"))


@register("gibberish_lm", sql=f"""
WITH grams AS MATERIALIZED (SELECT gram, count(*) AS n FROM {_grams_sql('documents', 'doc_id')} GROUP BY gram),
contexts AS (SELECT gram[1:2] AS ctx, sum(n) AS n FROM grams GROUP BY ALL), letters AS (SELECT count(DISTINCT gram[3:3]) AS v FROM grams),
own AS (SELECT conv_id, turn, gram, count(*) AS n FROM {_grams_sql('conversations', 'conv_id, turn')} GROUP BY ALL),
s AS (SELECT conv_id, turn, round(sum(own.n * ln((coalesce(g.n, 0) + {charlm.ALPHA}) / (coalesce(c.n, 0) + {charlm.ALPHA} * v))) / sum(own.n), 6) AS score
  FROM own LEFT JOIN grams g ON g.gram = own.gram LEFT JOIN contexts c ON c.ctx = own.gram[1:2], letters GROUP BY conv_id, turn)
SELECT conv_id, turn, score FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE text IS NOT NULL) LEFT JOIN s USING (conv_id, turn)""")
def gibberish_lm(spark, sf_dir):
    """V2: mean log-probability of every conversation turn under the documents' character model."""
    model = charlm.fit(load(spark, sf_dir, "documents"))
    return charlm.score(load(spark, sf_dir, "conversations"), model, ["conv_id", "turn"]).select("conv_id", "turn", F.col("score"))


def log_odds(features, labels, dim):
    """Weights without a fit: smoothed log-odds of the mean absolute value of a bucket in either class."""
    both = features.join(labels, "doc_id").groupBy("idx").agg(
        F.sum(F.when(F.col("toxic") == 1, F.abs("value")).otherwise(0.0)).alias("one"), F.sum(F.when(F.col("toxic") == 0, F.abs("value")).otherwise(0.0)).alias("zero"))
    return both.select("idx", F.log((F.col("one") + 0.1) / (F.col("zero") + 0.1)).alias("w"))


@register("linear_scores", sql=f"""
WITH {hash_features_sql('d', 'documents', 'doc_id', 'text')},
w AS (SELECT idx, ln((sum(CASE WHEN toxic = 1 THEN abs(value) ELSE 0 END) + 0.1) / (sum(CASE WHEN toxic = 0 THEN abs(value) ELSE 0 END) + 0.1)) AS w
  FROM d_f JOIN labels ON doc_id = id GROUP BY idx),
m AS (SELECT id, sum(value * w) AS m FROM d_f JOIN w USING (idx) GROUP BY id)
SELECT doc_id, round(1 / (1 + exp(-coalesce(m, 0))), 6) AS score FROM documents LEFT JOIN m ON id = doc_id""")
def linear_scores(spark, sf_dir):
    """V3, V6: every document scored from a table of weights (log-odds of the labelled documents' buckets)."""
    docs = load(spark, sf_dir, "documents")
    # written once each: the weights are counted and joined, and the features read for them and for the scores
    features = materialize(classifier.features_of(docs, dim=DIM), "features")
    weights = materialize(log_odds(features, load(spark, sf_dir, "labels"), DIM), "weights")
    return classifier.scores(features, docs, weights, 0.0)


def toxic_model(spark, sf_dir):
    """A model of the labelled documents that aren't held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    kept = labels.where(~classifier.held_out("doc_id"))
    return classifier.fit(classifier.features_of(docs.join(kept.select("doc_id"), "doc_id", "left_semi")), kept, label_col="toxic")


@register("trained_guard_eval")
def trained_guard_eval(spark, sf_dir):
    """V3, V6: the trained scanner on the held-out fifth of the labelled documents, as counts of
    label and verdict (no SQL twin: the weights are fitted)."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where(classifier.held_out("doc_id"))
    model = toxic_model(spark, sf_dir)
    tested = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    found = classifier.scores(classifier.features_of(tested), tested, model.weights, model.intercept)
    verdict = tested.select("doc_id", "toxic").join(found, "doc_id").withColumn("flagged", ~classifier.scanner("score")["is_valid"])
    return verdict.groupBy("toxic", "flagged").agg(F.count(F.lit(1)).alias("n"))


@register("output_verdict_trained")
def output_verdict_trained(spark, sf_dir):
    """V6, V7: output scanners on assistant turns with the trained scanner in the place of the bias
    scanner (no SQL twin: the weights are fitted)."""
    model = toxic_model(spark, sf_dir)
    turns = load(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    turns = turns.withColumn("doc_id", F.concat_ws(":", "conv_id", "turn"))
    found = classifier.scores(classifier.features_of(turns), turns, model.weights, model.intercept)
    v = guard.verdict(turns.join(found, "doc_id"), guard.output_scanners(F.col("text"), bias=classifier.scanner("score")))
    return v.select("conv_id", "turn", F.col("guard_valid").alias("is_valid"), F.col("guard_reason").alias("reason"))
