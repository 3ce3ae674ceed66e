"""Registered rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import render
from tessera.operators import lexical
from tessera.operators.fuse import context_lists
from tessera.plans.registry import register
from tessera.plans.sql_render import (clean_time_sql, course_sentence_sql, course_text_sql,
                                      format_time_sql, review_text_sql)
from tessera.plans.sqlfrag import tfidf_ctes
from tessera.session import work_path
from tessera.sources import files
from tessera.sources.tables import COURSES_SQL, REVIEWS_SQL, benchmark_queries, courses, load, reviews


@register("time_format", sql=f"""
SELECT crn, begin_time, {clean_time_sql('begin_time')} AS begin_clean,
  {format_time_sql(clean_time_sql('begin_time'))} AS begin_fmt,
  {format_time_sql(clean_time_sql('end_time'))} AS end_fmt FROM {COURSES_SQL}""")
def time_format(spark, sf_dir):
    c = courses(spark, sf_dir)
    return c.select("crn", "begin_time", render.clean_time("begin_time").alias("begin_clean"),
                    render.format_time(render.clean_time("begin_time")).alias("begin_fmt"),
                    render.format_time(render.clean_time("end_time")).alias("end_fmt"))


@register("course_text", sql=f"SELECT crn, {course_text_sql()} AS text FROM {COURSES_SQL}")
def course_text(spark, sf_dir):
    return render.add_course_text(courses(spark, sf_dir)).select("crn", "text")


@register("course_sentence", sql=f"SELECT crn, {course_sentence_sql()} AS text FROM {COURSES_SQL}")
def course_sentence(spark, sf_dir):
    return render.add_course_sentence(courses(spark, sf_dir)).select("crn", "text")


@register("review_text", sql=f"SELECT crn, {review_text_sql()} AS text FROM {REVIEWS_SQL}")
def review_text(spark, sf_dir):
    return reviews(spark, sf_dir).select("crn", render.review_text().alias("text"))


PROMPT_K = 3


@register("prompt_table", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0),
ctx AS (SELECT qid, string_agg(d.text, chr(10) ORDER BY rank) AS context, count(*) AS n_docs
  FROM ranked JOIN documents d ON d.doc_id = ranked.doc_id WHERE rank <= {PROMPT_K} GROUP BY qid)
SELECT b.item_id AS query_id, CAST(coalesce(n_docs, 0) AS INTEGER) AS n_docs,
  CASE WHEN n_docs > 0 THEN 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Query: ' || b.text
    || chr(10) || chr(10) || 'Answer:' ELSE 'Query: ' || b.text || chr(10) || chr(10) || 'Answer:' END AS prompt
FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id""")
def prompt_table(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    q = benchmark_queries(spark, sf_dir)
    idx = lexical.fit_tfidf(docs)
    hits = lexical.search(idx, q, PROMPT_K)
    ctx = context_lists(hits.join(docs.select("doc_id", "text"), "doc_id"), "query_id", "rank", "text")
    out = q.join(ctx, "query_id", "left")
    return out.select("query_id", F.size(F.coalesce("docs", F.array().cast("array<string>"))).cast("int").alias("n_docs"),
                      render.prompt("query", "docs").alias("prompt"))


@register("csv_roundtrip", sql=f"SELECT * FROM {COURSES_SQL}")
def csv_roundtrip(spark, sf_dir):
    """Write the course table as CSV (K1) and read it back with the fixed schema."""
    path = work_path(spark, "courses-csv")
    files.write_csv(courses(spark, sf_dir), path, files.COURSE_HEADERS)
    return files.read_courses(spark, path)


@register("csv_counts", sql=f"""
SELECT 'courses' AS sink, count(*) AS n FROM {COURSES_SQL} UNION ALL SELECT 'reviews', count(*) FROM {REVIEWS_SQL}
UNION ALL SELECT 'none', 0""")
def csv_counts(spark, sf_dir):
    """A7 + F8: record counts observed by the CSV writes themselves; an empty frame writes nothing."""
    c, r = courses(spark, sf_dir), reviews(spark, sf_dir)
    counts = [("courses", files.write_csv(c, work_path(spark, "count-courses"), files.COURSE_HEADERS)),
              ("reviews", files.write_csv(r, work_path(spark, "count-reviews"), files.REVIEW_HEADERS)),
              ("none", files.write_csv(c.where(F.lit(False)), work_path(spark, "count-none"), files.COURSE_HEADERS))]
    return spark.createDataFrame(counts, "sink string, n long")


@register("reviews_csv_roundtrip", sql=f"SELECT * FROM {REVIEWS_SQL}")
def reviews_csv_roundtrip(spark, sf_dir):
    """K1 + S2: review rows (multi-line texts, quotes) written as CSV and read back."""
    path = work_path(spark, "reviews-csv")
    files.write_csv(reviews(spark, sf_dir), path, files.REVIEW_HEADERS)
    return files.read_reviews(spark, path)
