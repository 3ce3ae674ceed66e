"""Landed API responses (S3, S4, J1, P4, P11): section listings and meeting
details as JSON, parsed with fixed schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.render import day_list

S = T.StringType()
SECTION = T.StructType([T.StructField("courseReferenceNumber", S), T.StructField("courseTitle", S),
                        T.StructField("subjectCourse", S), T.StructField("campusDescription", S),
                        T.StructField("subject", S), T.StructField("term", S)])
LISTING_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(SECTION))])
MEETING_TIME = T.StructType([T.StructField("beginTime", S), T.StructField("endTime", S)] +
                            [T.StructField(d, T.BooleanType()) for d in
                             ["monday", "tuesday", "wednesday", "thursday", "friday"]])
FMT = T.StructType([T.StructField("meetingTime", MEETING_TIME),
                    T.StructField("faculty", T.ArrayType(T.StructType([T.StructField("displayName", S)])))])
MEETING_SCHEMA = T.StructType([T.StructField("fmt", T.ArrayType(FMT))])


def read_sections(spark: SparkSession, path: str, subject: str | None = None,
                  multiline: bool = False) -> DataFrame:
    """S3: one row per section of every landed listing; a missing ``data`` is [].
    ``multiline=True`` for one pretty-printed response per file, else JSON lines."""
    raw = spark.read.schema(LISTING_SCHEMA).option("multiLine", multiline).json(path)
    rows = raw.select(F.explode(F.coalesce(F.col("data"), F.array().cast(T.ArrayType(SECTION))))
                      .alias("s")).select("s.*")
    if subject:
        rows = rows.where(F.col("subject") == subject)
    return rows.select(F.col("courseReferenceNumber").alias("crn"), F.col("courseTitle").alias("course_title"),
                       F.col("subjectCourse").alias("subject_course"),
                       F.col("campusDescription").alias("campus_description"), "term")


def parse_meetings(df: DataFrame, crn_col: str = "crn", json_col: str = "json") -> DataFrame:
    """(crn, json) -> faculty name, begin, end, day list; '' when absent."""
    m = df.select(F.col(crn_col).alias("crn"),
                  F.get(F.from_json(json_col, MEETING_SCHEMA)["fmt"], 0).alias("f"))
    mt = F.col("f.meetingTime")
    return m.select("crn",
                    F.coalesce(F.get(F.col("f.faculty"), 0)["displayName"], F.lit("")).alias("faculty_name"),
                    F.coalesce(mt["beginTime"], F.lit("")).alias("begin_time"),
                    F.coalesce(mt["endTime"], F.lit("")).alias("end_time"),
                    F.coalesce(day_list(mt), F.lit("")).alias("days"))


def assemble_courses(sections: DataFrame, meetings: DataFrame, descriptions: DataFrame | None = None,
                     prerequisites: DataFrame | None = None, term_label: str = "Spring 2025") -> DataFrame:
    """P11 + J1: sections left-joined to meeting, description and prerequisite rows
    by crn; a failed lookup keeps the row with '' defaults (Q16)."""
    out = sections.join(meetings, "crn", "left")
    if descriptions is not None:
        out = out.join(descriptions, "crn", "left")
    else:
        out = out.withColumn("course_description", F.lit(""))
    if prerequisites is not None:
        out = out.join(prerequisites, "crn", "left")
    else:
        out = out.withColumn("prerequisites", F.lit("[]"))
    return out.select(
        "crn", F.coalesce("campus_description", F.lit("")).alias("campus_description"),
        F.coalesce("course_title", F.lit("")).alias("course_title"),
        F.coalesce("subject_course", F.lit("")).alias("subject_course"),
        F.coalesce("faculty_name", F.lit("")).alias("faculty_name"),
        F.coalesce("course_description", F.lit("")).alias("course_description"),
        F.lit(term_label).alias("term"),
        F.coalesce("begin_time", F.lit("")).alias("begin_time"),
        F.coalesce("end_time", F.lit("")).alias("end_time"),
        F.coalesce("days", F.lit("")).alias("days"),
        F.coalesce("prerequisites", F.lit("[]")).alias("prerequisites"))


def meeting_json_from_part(part: DataFrame, part_suppliers: DataFrame) -> DataFrame:
    """Landed meeting responses derived from the part, lineitem and supplier tables (test input)."""
    j = part.join(part_suppliers, part_suppliers.l_partkey == part.p_partkey, "left")
    size = F.col("p_size")
    fac = F.when((F.col("p_partkey") % 7 == 0) | F.col("s_name").isNull(), F.array().cast("array<struct<displayName:string>>")) \
        .otherwise(F.array(F.struct(F.col("s_name").alias("displayName"))))
    mt = F.struct(((size % 24) * 100).cast("string").alias("beginTime"),
                  (((size + 1) % 24) * 100).cast("string").alias("endTime"),
                  (size % 2 == 0).alias("monday"), (size % 3 == 0).alias("tuesday"),
                  (size % 2 == 0).alias("wednesday"), (size % 3 == 0).alias("thursday"),
                  (size % 5 == 0).alias("friday"))
    js = F.to_json(F.struct(F.array(F.struct(mt.alias("meetingTime"), fac.alias("faculty"))).alias("fmt")))
    return j.select(F.col("p_partkey").cast("string").alias("crn"), js.alias("json"))


LISTING_PAGE = 50


def listing_json_from_part(part: DataFrame) -> DataFrame:
    """Landed section-listing responses derived from ``part`` (test input): one
    response per page of at most LISTING_PAGE sections, like a paginated API."""
    k = F.col("p_partkey")
    sec = F.struct(k.cast("string").alias("courseReferenceNumber"), F.col("p_name").alias("courseTitle"),
                   F.concat(F.lit("CS"), (F.lit(1000) + k % 9000).cast("string")).alias("subjectCourse"),
                   F.when(k % 4 == 0, "Online").when(k % 4 == 1, "No campus, no room needed")
                   .when(k % 4 == 2, "Boston").otherwise("Oakland, CA").alias("campusDescription"),
                   F.lit("CS").alias("subject"), F.lit("Spring 2025").alias("term"))
    return (part.select(F.floor(k / LISTING_PAGE).alias("page"), sec.alias("s"))
            .groupBy("page").agg(F.collect_list("s").alias("data")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """K3/K4: JSON lines sink."""
    df.write.mode("overwrite").json(path)
