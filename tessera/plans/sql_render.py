"""DuckDB twins of the rendering expressions (oracle side only)."""

from __future__ import annotations

from tessera.config import REVIEW_TEMPLATE
from tessera.plans.sqlfrag import sq


def clean_time_sql(x: str) -> str:
    d = f"try_cast({x} AS DOUBLE)"
    s = f"CAST(CAST(trunc({d}) AS BIGINT) AS VARCHAR)"
    return (f"(CASE WHEN {d} IS NULL OR {d} = 0 THEN NULL WHEN length({s}) >= 4 THEN {s} "
            f"ELSE lpad({s}, 4, '0') END)")


def format_time_sql(t: str) -> str:
    h = f"try_cast(substr({t}, 1, 2) AS INTEGER)"
    h12 = f"(CASE WHEN {h} > 12 THEN {h} - 12 WHEN {h} = 0 THEN 12 ELSE {h} END)"
    return (f"(CASE WHEN {t} IS NULL OR length({t}) <> 4 OR {h} IS NULL THEN NULL "
            f"ELSE CAST({h12} AS VARCHAR) || ':' || substr({t}, 3, 2) || ' ' || "
            f"(CASE WHEN {h} < 12 THEN 'AM' ELSE 'PM' END) END)")


def blank_null_sql(x: str) -> str:
    return f"(CASE WHEN trim({x}) = '' THEN NULL ELSE {x} END)"


def format_sql(campus: str) -> str:
    c = f"lower(coalesce({campus}, ''))"
    return (f"(CASE WHEN {c} = 'online' THEN 'Online' WHEN {c} = 'no campus, no room needed' "
            f"THEN 'Self-paced' ELSE 'In-Person' END)")


def prereq_body_sql(p: str) -> str:
    return (f"replace(replace(regexp_replace({p}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), "
            f"chr(39), ''), '\"', '')")


def prereq_sql(p: str) -> str:
    return (f"(CASE WHEN {p} IS NULL OR {p} = '[]' OR trim({p}) = '' THEN 'None required' "
            f"ELSE {prereq_body_sql(p)} END)")


def has_schedule_sql(b: str, e: str, d: str) -> str:
    return f"({b} IS NOT NULL AND {e} IS NOT NULL AND coalesce(length({d}) > 0, false))"


def course_text_sql() -> str:
    b, e = clean_time_sql("begin_time"), clean_time_sql("end_time")
    d = blank_null_sql("days")
    fb = f"coalesce({format_time_sql(b)}, 'None')"
    fe = f"coalesce({format_time_sql(e)}, 'None')"
    nl = "chr(10)"
    sched = (f"(CASE WHEN {has_schedule_sql(b, e, d)} THEN 'Days: ' || {d} || {nl} || 'Time: ' || "
             f"{fb} || ' to ' || {fe} || {nl} ELSE 'Schedule: Flexible/Self-paced' || {nl} END)")
    c = lambda x: f"coalesce({x}, '')"
    parts = [
        f"'=== COURSE METADATA ===' || {nl} || 'Course Code: ' || {c('subject_course')} || {nl}",
        f"'CRN: ' || {c('crn')} || {nl} || 'Title: ' || {c('course_title')} || {nl} || {nl}",
        f"'=== LOCATION ===' || {nl} || 'Campus: ' || {c('campus_description')} || {nl}",
        f"'Format: ' || {format_sql('campus_description')} || {nl} || {nl}",
        f"'=== SCHEDULE ===' || {nl} || {sched} || {nl}",
        f"'=== INSTRUCTOR ===' || {nl} || 'Professor: ' || "
        f"coalesce({blank_null_sql('faculty_name')}, 'Not specified') || {nl} || {nl}",
        f"'=== COURSE DETAILS ===' || {nl} || 'Term: ' || {c('term')} || {nl}",
        f"'Prerequisites: ' || {prereq_sql('prerequisites')} || {nl} || {nl}",
        f"'=== DESCRIPTION ===' || {nl} || "
        f"coalesce({blank_null_sql('course_description')}, 'No description available') || {nl}",
    ]
    return "lower(" + " || ".join(parts) + ")"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def course_sentence_sql() -> str:
    c = lambda x: f"coalesce({x}, '')"
    lc = f"lower({c('campus_description')})"
    campus = (f"(CASE WHEN {lc} = 'online' THEN 'is an online course' WHEN {lc} = "
              f"'no campus, no room needed' THEN 'is a self-paced course' ELSE 'is offered at ' || "
              f"{c('campus_description')} END)")
    b, e = clean_time_sql("begin_time"), clean_time_sql("end_time")
    d = blank_null_sql("days")
    fb = f"coalesce({format_time_sql(b)}, 'None')"
    fe = f"coalesce({format_time_sql(e)}, 'None')"
    sched = (f"(CASE WHEN {has_schedule_sql(b, e, d)} THEN 'with classes scheduled ' || {d} || "
             f"' from ' || {fb} || ' to ' || {fe} END)")
    fac = blank_null_sql("faculty_name")
    teacher = f"(CASE WHEN {fac} IS NOT NULL THEN 'taught by Professor ' || {fac} END)"
    head = (f"concat_ws(' ', {c('subject_course')} || ' (CRN: ' || {c('crn')} || '), ' || "
            f"{c('course_title')} || ',', {campus}, 'for ' || {c('term')}, {sched}, {teacher}) || '.'")
    desc = blank_null_sql("course_description")
    desc_part = f"(CASE WHEN {desc} IS NOT NULL THEN ' ' || {collapse_sql(desc)} ELSE '' END)"
    p = "prerequisites"
    body = prereq_body_sql(p)
    pre = (f"(CASE WHEN {p} IS NULL OR {p} = '[]' OR trim({p}) = '' THEN "
           f"' This course is open to all students with no prerequisites required.' "
           f"WHEN {body} <> '' THEN ' Prerequisites for this course: ' || {body} || '.' ELSE '' END)")
    return collapse_sql(f"{head} || {desc_part} || {pre}")


def review_text_sql() -> str:
    c = lambda x: f"coalesce({x}, '')"
    return (f"format({sq(REVIEW_TEMPLATE.replace('%s', '{}'))}, {c('crn')}, {c('course_name')}, "
            f"{c('instructor')}, {c('subject')}, {c('course_number')}, {c('question')}, {c('review')})")
