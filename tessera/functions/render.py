"""Scalar rendering of course and review rows (P1-P8, P15-P17). Pure Column
expressions: one projection, no UDF, everything inside whole-stage codegen.

Missing values (SQL NULL or blank) take the documented defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import REVIEW_TEMPLATE
from tessera.functions.text import collapse_ws

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def clean_time(t) -> Column:
    """NULL/blank/0 -> NULL; else the integer part zero-padded to 4 (not truncated)."""
    d = _c(t).cast("string").try_cast("double")
    s = d.cast("long").cast("string")
    return (F.when(d.isNull() | (d == 0), F.lit(None).cast("string"))
            .when(F.length(s) >= 4, s).otherwise(F.lpad(s, 4, "0")))


def format_time(t) -> Column:
    """HHMM -> 'h:MM AM|PM'; NULL unless exactly 4 characters with a numeric hour."""
    t = _c(t)
    h = F.substring(t, 1, 2).try_cast("int")
    mm = F.substring(t, 3, 2)
    hour12 = F.when(h > 12, h - 12).when(h == 0, F.lit(12)).otherwise(h)
    period = F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM"))
    return (F.when(t.isNull() | (F.length(t) != 4) | h.isNull(), F.lit(None).cast("string"))
            .otherwise(F.concat(hour12.cast("string"), F.lit(":"), mm, F.lit(" "), period)))


def delivery_format(campus) -> Column:
    """P3."""
    c = F.lower(F.coalesce(_c(campus), F.lit("")))
    return (F.when(c == "online", F.lit("Online"))
            .when(c == "no campus, no room needed", F.lit("Self-paced"))
            .otherwise(F.lit("In-Person")))


def day_list(meeting) -> Column:
    """Weekday flags of a struct -> 'Monday, Wednesday' in weekday order."""
    m = _c(meeting)
    names = F.array(*[F.when(F.coalesce(m[d], F.lit(False)), F.lit(d.capitalize())) for d in DAYS])
    return F.array_join(F.filter(names, lambda x: x.isNotNull()), ", ")


def prereq_text(p) -> Column:
    """P5: '[]'/blank -> 'None required'; else outer brackets stripped, quotes dropped."""
    p = _c(p)
    body = F.translate(F.regexp_replace(p, r"^[\[\]]+|[\[\]]+$", ""), "'\"", "")
    return (F.when(p.isNull() | (p == "[]") | (F.trim(p) == ""), F.lit("None required"))
            .otherwise(body))


def _has_schedule(begin, end, days) -> Column:
    return begin.isNotNull() & end.isNotNull() & F.coalesce(F.length(days) > 0, F.lit(False))


COURSE_FIELDS = dict(crn="crn", campus="campus_description", title="course_title",
                     subject_course="subject_course", faculty="faculty_name",
                     description="course_description", term="term", begin="begin_time",
                     end="end_time", days="days", prerequisites="prerequisites")


def _course_stage(df, f):
    """Shared first projections: cleaned times, blanks as NULL, formatted times.

    Each value is computed once in its own projection and later read by
    reference; nesting the expressions instead would copy them many times into
    the generated code."""
    s1 = df.select("*",
                   clean_time(f["begin"]).alias("_b"), clean_time(f["end"]).alias("_e"),
                   blank_to_null(f["days"]).alias("_d"), blank_to_null(f["faculty"]).alias("_fac"),
                   blank_to_null(f["description"]).alias("_desc"))
    return s1.select("*", F.coalesce(format_time("_b"), F.lit("None")).alias("_fb"),
                     F.coalesce(format_time("_e"), F.lit("None")).alias("_fe"),
                     _has_schedule(F.col("_b"), F.col("_e"), F.col("_d")).alias("_sched"))


_TEMP = ["_b", "_e", "_d", "_fac", "_desc", "_fb", "_fe", "_sched"]


def add_course_text(df, out: str = "text", **fields):
    """Six lowercased sections separated by a blank line."""
    f = {**COURSE_FIELDS, **fields}
    e = lambda c: F.coalesce(F.col(f[c]), F.lit(""))
    s = _course_stage(df, f)
    schedule = F.when(F.col("_sched"),
                      F.concat(F.lit("Days: "), F.col("_d"), F.lit("\nTime: "), F.col("_fb"),
                               F.lit(" to "), F.col("_fe"), F.lit("\n"))
                      ).otherwise(F.lit("Schedule: Flexible/Self-paced\n"))
    text = F.concat(
        F.lit("=== COURSE METADATA ===\nCourse Code: "), e("subject_course"), F.lit("\nCRN: "), e("crn"),
        F.lit("\nTitle: "), e("title"), F.lit("\n\n"),
        F.lit("=== LOCATION ===\nCampus: "), e("campus"), F.lit("\nFormat: "),
        delivery_format(f["campus"]), F.lit("\n\n"),
        F.lit("=== SCHEDULE ===\n"), schedule, F.lit("\n"),
        F.lit("=== INSTRUCTOR ===\nProfessor: "), F.coalesce(F.col("_fac"), F.lit("Not specified")),
        F.lit("\n\n"),
        F.lit("=== COURSE DETAILS ===\nTerm: "), e("term"), F.lit("\nPrerequisites: "),
        prereq_text(f["prerequisites"]), F.lit("\n\n"),
        F.lit("=== DESCRIPTION ===\n"), F.coalesce(F.col("_desc"), F.lit("No description available")),
        F.lit("\n"),
    )
    return s.select("*", F.lower(text).alias(out)).drop(*_TEMP)


def add_course_sentence(df, out: str = "text", **fields):
    """One prose sentence + description + prerequisites, whitespace collapsed."""
    f = {**COURSE_FIELDS, **fields}
    e = lambda c: F.coalesce(F.col(f[c]), F.lit(""))
    s = _course_stage(df, f)
    lc = F.lower(e("campus"))
    campus_part = (F.when(lc == "online", F.lit("is an online course"))
                   .when(lc == "no campus, no room needed", F.lit("is a self-paced course"))
                   .otherwise(F.concat(F.lit("is offered at "), e("campus"))))
    schedule = F.when(F.col("_sched"),
                      F.concat(F.lit("with classes scheduled "), F.col("_d"), F.lit(" from "),
                               F.col("_fb"), F.lit(" to "), F.col("_fe")))
    teacher = F.when(F.col("_fac").isNotNull(), F.concat(F.lit("taught by Professor "), F.col("_fac")))
    head = F.concat(
        F.concat_ws(" ", F.concat(e("subject_course"), F.lit(" (CRN: "), e("crn"), F.lit("), "),
                                  e("title"), F.lit(",")),
                    campus_part, F.concat(F.lit("for "), e("term")), schedule, teacher),
        F.lit("."))
    desc_part = F.when(F.col("_desc").isNotNull(),
                       F.concat(F.lit(" "), collapse_ws("_desc"))).otherwise(F.lit(""))
    p = F.col(f["prerequisites"])
    s = s.select("*", F.translate(F.regexp_replace(p, r"^[\[\]]+|[\[\]]+$", ""), "'\"", "")
                 .alias("_pb"))
    pre = (F.when(p.isNull() | (p == "[]") | (F.trim(p) == ""),
                  F.lit(" This course is open to all students with no prerequisites required."))
           .when(F.col("_pb") != "", F.concat(F.lit(" Prerequisites for this course: "), F.col("_pb"),
                                              F.lit(".")))
           .otherwise(F.lit("")))
    return s.select("*", collapse_ws(F.concat(head, desc_part, pre)).alias(out)).drop(*_TEMP, "_pb")


def review_text(crn="crn", course_name="course_name", instructor="instructor", subject="subject",
                course_number="course_number", question="question", review="review") -> Column:
    """The multi-line review document (case kept)."""
    e = lambda c: F.coalesce(_c(c), F.lit(""))
    return F.format_string(REVIEW_TEMPLATE, e(crn), e(course_name), e(instructor), e(subject),
                           e(course_number), e(question), e(review))


def prompt(query, docs) -> Column:
    """P17 user message: with context when the doc list is non-empty."""
    q, d = _c(query), _c(docs)
    return (F.when(F.size(F.coalesce(d, F.array().cast("array<string>"))) > 0,
                   F.concat(F.lit("Context:\n"), F.array_join(d, "\n"), F.lit("\n\nQuery: "), q,
                            F.lit("\n\nAnswer:")))
            .otherwise(F.concat(F.lit("Query: "), q, F.lit("\n\nAnswer:"))))


def messages(system_prompt, user_content) -> Column:
    """P17 chat messages: system + user."""
    return F.array(
        F.struct(F.lit("system").alias("role"), _c(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(user_content).alias("content")))
