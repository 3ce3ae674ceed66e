"""CSV sources and sinks with fixed all-string schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COURSE_COLUMNS = ["crn", "campus_description", "course_title", "subject_course", "faculty_name",
                  "course_description", "term", "begin_time", "end_time", "days", "prerequisites"]
REVIEW_COLUMNS = ["crn", "course_name", "instructor", "subject", "course_number", "question",
                  "review"]

# Header names as they appear in landed CSV files, in column order.
COURSE_HEADERS = ["CRN", "Campus Description", "Course Title", "Subject Course", "Faculty Name",
                  "Course Description", "Term", "Begin Time", "End Time", "Days", "Prerequisites"]
REVIEW_HEADERS = ["CRN", "Course Name", "Instructor", "Subject", "Course Number", "Question",
                  "Review"]
# Module variant of the course scraper names the campus column "Campus".
HEADER_ALIASES = {"Campus": "campus_description"}

COURSES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COURSE_COLUMNS])
REVIEWS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REVIEW_COLUMNS])


def snake(name: str) -> str:
    return HEADER_ALIASES.get(name, name.strip().lower().replace(" ", "_"))


def _reader(spark: SparkSession):
    return (spark.read.option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "PERMISSIVE"))


def read_string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read a headed CSV as all-string columns, mapping header names to snake
    case; columns missing from the file become NULL. Blank cells are NULL."""
    raw = _reader(spark).option("inferSchema", False).csv(path)
    present = {snake(c): c for c in raw.columns}
    return raw.select(*[
        (F.col(f"`{present[c]}`").cast("string") if c in present else F.lit(None).cast("string"))
        .alias(c) for c in columns])


def read_courses(spark: SparkSession, path: str) -> DataFrame:
    """S1."""
    return read_string_csv(spark, path, COURSE_COLUMNS)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return read_string_csv(spark, path, REVIEW_COLUMNS)


def write_csv(df: DataFrame, path: str, headers: list[str] | None = None) -> int:
    """K1: header, no index column; returns the record count from an observed
    metric of the write job itself (no second pass). Empty frames are skipped (F8)."""
    if df.isEmpty():
        return 0
    if headers:
        df = df.toDF(*headers)
    obs = Observation("csv_sink")
    observed = df.observe(obs, F.count(F.lit(1)).alias("n"))
    observed.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return int(obs.get["n"])
