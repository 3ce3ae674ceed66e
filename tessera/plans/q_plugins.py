"""Registered examples of each plug-in protocol (X1), with small models whose results SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import plugins
from tessera.plans.registry import register
from tessera.sources.tables import benchmark_queries, load

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_model():
    """An embedder: how often each letter stands in a text, over its length."""
    return lambda texts: [[t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts]


def symbol_model():
    """A text scorer: the share of characters that are neither ASCII letters nor blanks."""
    known = frozenset(LETTERS + LETTERS.upper() + " ")
    return lambda texts: [sum(c not in known for c in t) / max(len(t), 1) for t in texts]


def echo_model():
    """A generator: answers with the question's length and its first characters."""
    return lambda prompts: [f"You asked {len(p)} characters: {p[:20]}" for p in prompts]


@register("plugin_embedder", sql=f"""
SELECT doc_id, idx, value FROM (SELECT doc_id, unnest(range(0, {len(LETTERS)})) AS idx,
  unnest([round((length(text) - length(replace(text, c, ''))) / greatest(length(text), 1), 6) for c in string_split('{LETTERS}', '')]) AS value
  FROM documents WHERE text IS NOT NULL) WHERE value > 0""")
def plugin_embedder(spark, sf_dir):
    """Every document embedded by a plug-in, in sparse form."""
    embed = plugins.embedder("letters", letter_model)
    docs = load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    rows = docs.select("doc_id", F.posexplode(embed(F.col("text"))).alias("idx", "value"))
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value")).where("value > 0")


@register("plugin_text_scorer", sql="""
SELECT conv_id, turn, round(length(regexp_replace(text, '[A-Za-z ]', '', 'g')) / greatest(length(text), 1), 6) AS score FROM conversations""")
def plugin_text_scorer(spark, sf_dir):
    """Every conversation turn scored by a plug-in."""
    score = plugins.text_scorer("symbols", symbol_model)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(score(F.col("text")), 6).alias("score"))


@register("plugin_generator", sql="""
SELECT item_id AS query_id, 'You asked ' || length(text) || ' characters: ' || left(text, 20) AS response FROM benchmark""")
def plugin_generator(spark, sf_dir):
    """A response to every benchmark item from a plug-in."""
    generate = plugins.generator("echo", echo_model)
    return benchmark_queries(spark, sf_dir).select("query_id", generate(F.col("query")).alias("response"))
