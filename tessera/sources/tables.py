"""Readers for the given tables and the derived views that give them the
reference's input shapes (courses, reviews, report lines, query sets).

Every view here is a plain projection of a given table, so its size grows with
the table and Catalyst prunes columns and pushes filters into the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: one query per benchmark item."""
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def part_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_partkey, s_name): the supplier of each part's first order line (partial minima
    per part, then an equi-join; faculty names grow with the tables)."""
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    ps = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(first.alias("l")).select("l_partkey", "l.l_suppkey")
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return ps.join(sup, ps.l_suppkey == sup.s_suppkey).select("l_partkey", "s_name")


PART_SUPPLIERS_SQL = """(select l_partkey, s_name from (select l_partkey, l_suppkey, row_number() over (
 partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as line from lineitem) ps
 join supplier on s_suppkey = l_suppkey where line = 1)"""


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course rows (11 string columns) derived from ``part``, ``lineitem`` and ``supplier``."""
    part = load(spark, sf_dir, "part")
    sup = part_suppliers(spark, sf_dir)
    k = F.col("p_partkey")
    return part.join(sup, sup.l_partkey == k, "left").select(
        k.cast("string").alias("crn"),
        F.when(k % 4 == 0, "Online").when(k % 4 == 1, "No campus, no room needed")
        .when(k % 4 == 2, "Boston").otherwise("Oakland, CA").alias("campus_description"),
        F.col("p_name").alias("course_title"),
        F.concat(F.lit("CS"), (F.lit(1000) + k % 9000).cast("string")).alias("subject_course"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("faculty_name"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"))).alias("course_description"),
        F.lit("Spring 2025").alias("term"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .otherwise(((F.col("p_size") % 24) * 100 + (k % 4) * 15).cast("string")).alias("begin_time"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .otherwise((((F.col("p_size") + 1) % 24) * 100 + (k % 4) * 15).cast("string")).alias("end_time"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.lit("Monday, Wednesday")).alias("days"),
        F.when(k % 3 == 0, F.lit("[]"))
        .otherwise(F.lit("[{'and_or': '', 'subject': 'CS', 'course_number': '5010'}]")).alias("prerequisites"),
    )


COURSES_SQL = """(select cast(p_partkey as varchar) as crn,
 case p_partkey % 4 when 0 then 'Online' when 1 then 'No campus, no room needed' when 2 then 'Boston' else 'Oakland, CA' end as campus_description,
 p_name as course_title, concat('CS', cast(1000 + p_partkey % 9000 as varchar)) as subject_course,
 case when p_partkey % 7 = 0 then null else s_name end as faculty_name,
 case when p_partkey % 11 = 0 then null else concat(p_type, ' ', p_brand) end as course_description, 'Spring 2025' as term,
 case when p_partkey % 5 = 0 then null else cast((p_size % 24) * 100 + (p_partkey % 4) * 15 as varchar) end as begin_time,
 case when p_partkey % 5 = 0 then null else cast(((p_size + 1) % 24) * 100 + (p_partkey % 4) * 15 as varchar) end as end_time,
 case when p_partkey % 6 = 0 then null else 'Monday, Wednesday' end as days,
 case when p_partkey % 3 = 0 then '[]' else replace('[{~and_or~: ~~, ~subject~: ~CS~, ~course_number~: ~5010~}]', '~', chr(39)) end as prerequisites
from part left join """ + PART_SUPPLIERS_SQL + """ ps on l_partkey = p_partkey)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows (7 string columns) derived from ``documents``."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("crn"),
        F.col("source").alias("course_name"),
        F.col("lang").alias("instructor"),
        F.lit("CS").alias("subject"),
        (F.col("doc_id") % 9000 + 1000).cast("string").alias("course_number"),
        F.lit("What were the strengths?").alias("question"),
        F.col("text").alias("review"),
    )


REVIEWS_SQL = """(select cast(doc_id as varchar) as crn, source as course_name, lang as instructor,
 'CS' as subject, cast(doc_id % 9000 + 1000 as varchar) as course_number,
 'What were the strengths?' as question, text as review from documents)"""


# Course questions: the benchmark prose followed by one of these course questions,
# picked by item id, so the rule-based query parts have something to find.
COURSE_QUESTION_SUFFIXES = [
    "Who teaches Algorithms in Boston, Spring 2025?",
    "Is Artificial Intelligence offered online for Spring 2025?",
    "Which courses are in Boston?",
    "What is offered for spring 2025?",
    "Any course by Professor Rajagopal?",
]


def course_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_course_queries(load(spark, sf_dir, "benchmark"))


def as_course_queries(b: DataFrame) -> DataFrame:
    """(query_id, query) from benchmark rows (a table or a batch of a stream)."""
    n = len(COURSE_QUESTION_SUFFIXES)
    suffix = F.element_at(F.array(*[F.lit(s) for s in COURSE_QUESTION_SUFFIXES]),
                          (F.col("item_id") % n + 1).cast("int"))
    return b.select(F.col("item_id").alias("query_id"),
                    F.concat(suffix, F.lit(" "), F.col("text")).alias("query"))


def course_queries_sql() -> str:
    arr = ", ".join("'" + s.replace("'", "''") + "'" for s in COURSE_QUESTION_SUFFIXES)
    n = len(COURSE_QUESTION_SUFFIXES)
    return (f"(select item_id as query_id, concat([{arr}][item_id % {n} + 1], ' ', text) as query "
            f"from benchmark)")
