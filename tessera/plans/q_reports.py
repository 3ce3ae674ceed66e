"""Registered report, HTML and JSON extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import html as H
from tessera.operators import reports
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sq
from tessera.sources import landed
from tessera.sources.tables import PART_SUPPLIERS_SQL, load, part_suppliers

TERM = "(Spring 2024)"

LINES_SQL = """(WITH blocks AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc, 0 AS page, turn,
    CASE WHEN role = 'user' THEN 'Q: ' || text
         WHEN role = 'assistant' THEN CAST(turn AS VARCHAR) || chr(10) || chr(10) || text
         ELSE 'Instructor: ' || text END AS block FROM conversations),
parts AS (SELECT doc, page, turn, string_split(block, chr(10)) AS ls FROM blocks)
SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY turn, i) - 1 AS line_no, ls[i] AS line
FROM parts, unnest(range(1, len(ls) + 1)) AS t(i))"""


def _cls_sql(line: str) -> str:
    return (f"(CASE WHEN instr({line}, {sq(TERM)}) > 0 THEN 'course_name' "
            f"WHEN instr({line}, 'Instructor: ') > 0 THEN 'instructor' "
            f"WHEN instr({line}, 'Subject: ') > 0 THEN 'subject' "
            f"WHEN instr({line}, 'Catalog & Section: ') > 0 THEN 'course_number' "
            f"WHEN instr({line}, 'Course ID: ') > 0 THEN 'crn' "
            f"WHEN instr({line}, 'Q: ') > 0 THEN 'q' END)")


def _value_sql(line: str, cls: str) -> str:
    return (f"(CASE WHEN {cls} = 'course_name' THEN {line} "
            f"WHEN {cls} = 'instructor' THEN string_split({line}, 'Instructor: ')[2] "
            f"WHEN {cls} = 'subject' THEN string_split({line}, 'Subject: ')[2] "
            f"WHEN {cls} = 'course_number' THEN string_split(string_split({line}, 'Catalog & Section: ')[2], ' ')[1] "
            f"WHEN {cls} = 'crn' THEN string_split({line}, 'Course ID: ')[2] "
            f"WHEN {cls} = 'q' THEN string_split({line}, 'Q: ')[-1] END)")


ANNOTATED_SQL = f"""l AS {LINES_SQL},
c AS (SELECT *, {_cls_sql('line')} AS cls, instr(line, 'Q: ') > 0 AS hasq FROM l),
v AS (SELECT *, {_value_sql('line', 'cls')} AS value FROM c),
a AS (SELECT *,
  last_value(CASE WHEN hasq THEN {{'seg_line': line_no, 'seg_cls': cls, 'question': value}} END IGNORE NULLS)
    OVER (PARTITION BY doc, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
  first_value(CASE WHEN line <> '' THEN line END IGNORE NULLS)
    OVER (PARTITION BY doc, page ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line
  FROM v),
rv AS (SELECT doc, page, seg.seg_line AS seg_line, seg.question AS question, line_no, next_line AS review FROM a
  WHERE seg.seg_cls = 'q' AND NOT hasq AND regexp_full_match(line, '\\p{{N}}+') AND next_line IS NOT NULL),
lastq AS (SELECT doc, value AS question, max({{'page': page, 'line_no': line_no}}) AS m FROM a WHERE cls = 'q'
  GROUP BY doc, value),
rl AS (SELECT rv.* FROM rv JOIN lastq ON lastq.doc = rv.doc AND lastq.question = rv.question
  AND lastq.m.page = rv.page AND lastq.m.line_no = rv.seg_line),
md AS (SELECT doc,
  max_by(value, {{'page': page, 'line_no': line_no}}) FILTER (WHERE cls = 'course_name') AS course_name,
  max_by(value, {{'page': page, 'line_no': line_no}}) FILTER (WHERE cls = 'instructor') AS instructor,
  max_by(value, {{'page': page, 'line_no': line_no}}) FILTER (WHERE cls = 'subject') AS subject,
  max_by(value, {{'page': page, 'line_no': line_no}}) FILTER (WHERE cls = 'course_number') AS course_number,
  max_by(value, {{'page': page, 'line_no': line_no}}) FILTER (WHERE cls = 'crn') AS crn
  FROM a WHERE (seg IS NULL OR NOT (seg.seg_cls = 'q' AND NOT hasq))
    AND cls IN ('course_name', 'instructor', 'subject', 'course_number', 'crn') GROUP BY doc)"""


@register("report_reviews", sql=f"""WITH {ANNOTATED_SQL}
SELECT rl.doc AS crn, coalesce(course_name, '') AS course_name, coalesce(instructor, '') AS instructor,
  coalesce(subject, '') AS subject, coalesce(course_number, '') AS course_number, question, review,
  CAST(page AS INTEGER) AS page, CAST(line_no AS BIGINT) AS line_no
FROM rl LEFT JOIN md ON md.doc = rl.doc""")
def report_reviews(spark, sf_dir):
    """W1 + A6 + A8 + P14 on report pages built from conversations."""
    lines = reports.conversation_lines(load(spark, sf_dir, "conversations"))
    out = reports.review_rows(lines, TERM)
    return out.select("crn", "course_name", "instructor", "subject", "course_number", "question",
                      "review", F.col("page").cast("int"), F.col("line_no").cast("long"))


@register("report_metadata", sql=f"""WITH {ANNOTATED_SQL}
SELECT doc, course_name, instructor, subject, course_number, crn FROM md""")
def report_metadata(spark, sf_dir):
    """Last-wins metadata per report."""
    lines = reports.conversation_lines(load(spark, sf_dir, "conversations"))
    return reports.report_metadata(reports.annotate(lines, TERM))


def _strip_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def _unescape_sql(x: str) -> str:
    for ent, ch in H.ENTITIES:
        x = f"replace({x}, {sq(ent)}, {sq(ch)})"
    return x


@register("html_text", sql=f"""
SELECT page_id, trim(regexp_replace({_unescape_sql(_strip_sql("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"))},
  '\\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    """Whitespace-collapsed text of each page's first <article> ('' if absent)."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", H.element_text("html", "article").alias("text"))


@register("html_links", sql=f"""
WITH it AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1),
  '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM pages),
x AS (SELECT page_id, i, items[i] AS item FROM it, unnest(range(1, len(items) + 1)) AS t(i))
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(item, '(?is)href="([^"]*)"', 1) AS href,
  trim({_unescape_sql(_strip_sql('item'))}) AS text FROM x""")
def html_links(spark, sf_dir):
    """P10 (list form): one row per <li> of each page's <nav>: position, href, text."""
    p = load(spark, sf_dir, "pages")
    x = p.select("page_id", F.posexplode(H.items("html", "nav", "li")).alias("pos", "item"))
    return x.select("page_id", F.col("pos").cast("int"), H.link_href("item").alias("href"),
                    F.trim(H.unescape(H.strip_tags("item"))).alias("text"))


@register("section_days", sql=f"""
SELECT CAST(p_partkey AS VARCHAR) AS crn,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE coalesce(s_name, '') END AS faculty_name,
  CAST((p_size % 24) * 100 AS VARCHAR) AS begin_time,
  concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'Monday' END, CASE WHEN p_size % 3 = 0 THEN 'Tuesday' END,
    CASE WHEN p_size % 2 = 0 THEN 'Wednesday' END, CASE WHEN p_size % 3 = 0 THEN 'Thursday' END,
    CASE WHEN p_size % 5 = 0 THEN 'Friday' END) AS days
FROM part LEFT JOIN {PART_SUPPLIERS_SQL} ps ON l_partkey = p_partkey""")
def section_days(spark, sf_dir):
    """S3/S4 + P4 + J1: landed meeting JSON (built from part/supplier) parsed with the
    fixed schema; faculty name, begin time and the weekday list per section."""
    raw = landed.meeting_json_from_part(load(spark, sf_dir, "part"), part_suppliers(spark, sf_dir))
    m = landed.parse_meetings(raw)
    return m.select("crn", "faculty_name", "begin_time", "days")
