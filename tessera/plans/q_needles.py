"""Registered scans with needle and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import QUERY_RULES
from tessera.operators import needles
from tessera.plans.q_filters import _NB
from tessera.plans.q_guard import CORPUS_HITS_SQL, CORPUS_NEEDLES
from tessera.plans.registry import register
from tessera.session import spread
from tessera.sources.tables import course_queries, course_queries_sql, load

#: Letters of the words that serve as needles.
LEAST_LETTERS = 6


@register("banned_scan_table", sql=f"""
SELECT doc_id, array_to_string({CORPUS_HITS_SQL}, ', ') AS hits FROM documents WHERE len({CORPUS_HITS_SQL}) > 0""")
def banned_scan_table(spark, sf_dir):
    """V1 over all documents with the needles as a table; equals ``banned_scan_docs``."""
    table = spark.createDataFrame([(n, i) for i, n in enumerate(CORPUS_NEEDLES)], "needle string, position int")
    return needles.ban_needles(load(spark, sf_dir, "documents"), table, "doc_id")


@register("query_parts_table", sql=f"""
SELECT query_id, {_NB['course']} AS course, {_NB['professor']} AS professor, {_NB['term']} AS term,
  {_NB['campus']} AS campus FROM {course_queries_sql()}""")
def query_parts_table(spark, sf_dir):
    """F2 with the rules as a table; equals ``query_parts``."""
    rules = spark.createDataFrame(QUERY_RULES, "field string, priority int, needle string, value string")
    return needles.query_parts(course_queries(spark, sf_dir), rules)


def _words_sql(column: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) >= {LEAST_LETTERS})"


@register("needle_words", sql=f"""
WITH w AS (SELECT doc_id, {_words_sql('text')} AS words FROM documents)
SELECT doc_id, CAST(len(words) AS BIGINT) AS needles FROM w WHERE len(words) > 0""")
def needle_words(spark, sf_dir):
    """J7 with a large table: every word of six letters or more of all documents is a needle, looked for
    in every document as a whole word."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("needle"))
    words = words.where(F.length("needle") >= LEAST_LETTERS).distinct()
    found = needles.hits(docs, words, "doc_id", mode="word")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("needles"))
