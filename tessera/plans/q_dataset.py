"""Registered dataset-creation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import COURSE_NAMES, N_PROFESSORS, SAMPLE_SEED, SEED_TEMPLATES, SEMESTER, SLOT_PRIORITY, TOPICS
from tessera.operators import dataset as D
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sq
from tessera.session import work_path
from tessera.sources.tables import COURSES_SQL, courses

N_SAMPLE = 250
N_VARIANTS = 10


def _slot(t):
    return next((s for s in SLOT_PRIORITY if "{" + s + "}" in t), None)


TEMPLATES_SQL = "(VALUES " + ", ".join(
    f"({i}, {sq(t)}, {sq(_slot(t)) if _slot(t) else 'NULL'})" for i, t in enumerate(SEED_TEMPLATES)
) + ") AS tm(template_id, template, slot)"

PROFS_SQL = f"""(SELECT 'professor_name' AS kind, value FROM (SELECT DISTINCT faculty_name AS value FROM {COURSES_SQL}
  WHERE faculty_name IS NOT NULL) ORDER BY md5(value || '{SAMPLE_SEED}') LIMIT {N_PROFESSORS})"""

ENTITIES_SQL = ("(SELECT * FROM (VALUES " + ", ".join(
    [f"('semester', {sq(SEMESTER)})"] + [f"('course_name', {sq(c)})" for c in COURSE_NAMES] +
    [f"('topic', {sq(t)})" for t in TOPICS]) + f") AS e(kind, value) UNION ALL SELECT * FROM {PROFS_SQL})")

EXPANDED_SQL = f"""(SELECT template_id, value AS entity,
  CASE WHEN slot IS NULL THEN template ELSE replace(template, '{{' || slot || '}}', value) END AS question
  FROM {TEMPLATES_SQL} LEFT JOIN {ENTITIES_SQL} ents ON tm.slot = ents.kind)"""

VARIANTS_SQL = f"""(SELECT template_id, entity, question AS seed_question, i - 1 AS variant_idx,
  question || ' (variant ' || CAST(i AS VARCHAR) || ')' AS question
  FROM {EXPANDED_SQL} x, unnest(range(1, {N_VARIANTS} + 1)) AS t(i))"""


def _expanded(spark, sf_dir):
    c = courses(spark, sf_dir)
    return D.expand(D.templates(spark), D.entities(spark, c))


def _variants(spark, sf_dir):
    """Variant responses as a model would return them (JSON), derived from each
    seed question, then parsed and exploded (D2)."""
    x = _expanded(spark, sf_dir)
    resp = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(N_VARIANTS)),
                                          lambda i: F.concat(F.col("question"), F.lit(" (variant "),
                                                             i.cast("string"), F.lit(")"))).alias("question")))
    v = D.parse_variants(x.withColumn("response", resp))
    return v.select("template_id", "entity", F.col("question").alias("seed_question"),
                    "variant_idx", F.col("variant").alias("question"))


@register("distinct_entities", sql=f"""
SELECT DISTINCT faculty_name AS value FROM {COURSES_SQL} WHERE faculty_name IS NOT NULL""")
def distinct_entities(spark, sf_dir):
    """A4: distinct faculty names."""
    return D.distinct_values(courses(spark, sf_dir), "faculty_name")


@register("template_expand", sql=f"SELECT template_id, entity, question FROM {EXPANDED_SQL}")
def template_expand(spark, sf_dir):
    """D1 + J2 + T5: 14 templates x (sampled professors, semester, courses, topics)."""
    return _expanded(spark, sf_dir)


@register("variant_explode", sql=f"""
SELECT template_id, entity, seed_question, CAST(variant_idx AS INTEGER) AS variant_idx, question FROM {VARIANTS_SQL}""")
def variant_explode(spark, sf_dir):
    """D2 + U3: parsed variant lists, one row per variant."""
    return _variants(spark, sf_dir).withColumn("variant_idx", F.col("variant_idx").cast("int"))


@register("seeded_sample", sql=f"""
SELECT question FROM {VARIANTS_SQL} ORDER BY md5(question || '{SAMPLE_SEED}') LIMIT {N_SAMPLE}""")
def seeded_sample(spark, sf_dir):
    """T5: 250 questions sampled without replacement (md5 order, seed 3)."""
    return D.seeded_sample(_variants(spark, sf_dir).select("question"), "question", N_SAMPLE)


@register("batch_number", sql=f"""
SELECT crn, CAST(floor((row_number() OVER (ORDER BY CAST(crn AS BIGINT)) - 1) / 5) AS BIGINT) AS batch
FROM {COURSES_SQL}""")
def batch_number(spark, sf_dir):
    """Consecutive batches of 5 sections in crn order."""
    c = courses(spark, sf_dir).select("crn", F.col("crn").cast("long").alias("k"))
    return D.batch_numbers(c, ["k"], 5).select("crn", "batch")


@register("question_roundtrip", sql=f"SELECT question FROM {VARIANTS_SQL}")
def question_roundtrip(spark, sf_dir):
    """K4 + S7: the whole question list written as Parquet and read back."""
    path = work_path(spark, "questions")
    _variants(spark, sf_dir).select("question").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# The SFT set samples distinct question texts (the course list names one course
# twice, so some variants repeat); each question is then one query key.
SAMPLED_Q_SQL = f"""(SELECT md5(question) AS query_id, question AS query FROM (
  SELECT question FROM (SELECT DISTINCT question FROM {VARIANTS_SQL})
  ORDER BY md5(question || '{SAMPLE_SEED}') LIMIT {N_SAMPLE}))"""


def _sft_sql() -> str:
    from tessera.plans.q_rerank import integrated_sql
    return f"""WITH {integrated_sql(SAMPLED_Q_SQL)},
ctx AS (SELECT query_id, list(text ORDER BY rank2) AS docs FROM fr WHERE rank2 <= 10 GROUP BY query_id),
t AS (SELECT q.query_id, q.query AS question, coalesce(docs, []) AS docs FROM {SAMPLED_Q_SQL} q
  LEFT JOIN ctx ON ctx.query_id = q.query_id)
SELECT query_id, question, CAST(len(docs) AS INTEGER) AS n_context,
  coalesce(string_split(docs[1], chr(10))[1], '') AS response,
  'Question:' || chr(10) || question || chr(10) || 'Context:' || chr(10) || array_to_string(docs, chr(10))
  || chr(10) || 'Response:' || chr(10) || coalesce(string_split(docs[1], chr(10))[1], '') AS text FROM t"""


@register("sft_triples", sql=_sft_sql())
def sft_triples(spark, sf_dir):
    """D3 + D4 + Q13: sampled questions -> integrated retrieval (15/15 -> 10) ->
    context list -> response (offline default) -> rendered triple."""
    from tessera.plans import pipelines
    from tessera.plans.q_dense import review_docs
    from tessera.plans.q_filters import course_docs
    from tessera.operators.fuse import context_lists
    qs = D.seeded_sample(_variants(spark, sf_dir).select("question").distinct(), "question", N_SAMPLE)
    qs = qs.select(F.md5("question").alias("query_id"),
                   F.col("question").alias("query"))
    res = pipelines.integrated(course_docs(spark, sf_dir), review_docs(spark, sf_dir), qs)
    ctx = context_lists(res, "query_id", "rank", "text")
    t = D.triples(qs.withColumnRenamed("query", "question"), ctx)
    return t.select("query_id", "question", F.size("context").cast("int").alias("n_context"), "response", "text")
