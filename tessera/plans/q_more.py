"""More registered queries: landed listings and course assembly (S3, S4, J1, P11),
JSON-lines dataset sink (K3) and guard explanations (V9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import SEMESTER
from tessera.operators import guard as G
from tessera.plans.q_dataset import VARIANTS_SQL, _variants
from tessera.plans.q_guard import RELEVANCE_SQL, input_flags_sql, INPUT_REASON_SQL
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sq
from tessera.session import materialize, spread, work_path
from tessera.sources import landed
from tessera.sources.tables import PART_SUPPLIERS_SQL, load, part_suppliers


@register("course_assembly", sql=f"""
SELECT CAST(p_partkey AS VARCHAR) AS crn,
  CASE p_partkey % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'No campus, no room needed' WHEN 2 THEN 'Boston' ELSE 'Oakland, CA' END AS campus_description,
  p_name AS course_title, concat('CS', CAST(1000 + p_partkey % 9000 AS VARCHAR)) AS subject_course,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE coalesce(s_name, '') END AS faculty_name,
  '' AS course_description, {sq(SEMESTER)} AS term,
  CAST((p_size % 24) * 100 AS VARCHAR) AS begin_time, CAST(((p_size + 1) % 24) * 100 AS VARCHAR) AS end_time,
  concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'Monday' END, CASE WHEN p_size % 3 = 0 THEN 'Tuesday' END,
    CASE WHEN p_size % 2 = 0 THEN 'Wednesday' END, CASE WHEN p_size % 3 = 0 THEN 'Thursday' END,
    CASE WHEN p_size % 5 = 0 THEN 'Friday' END) AS days, '[]' AS prerequisites
FROM part LEFT JOIN {PART_SUPPLIERS_SQL} ps ON l_partkey = p_partkey""")
def course_assembly(spark, sf_dir):
    """S3 + S4 + J1 + P11: landed listing pages (JSON files) exploded to sections,
    left-joined to the landed meeting details, assembled into course rows."""
    part, sup = load(spark, sf_dir, "part"), part_suppliers(spark, sf_dir)
    path = work_path(spark, "listings")
    landed.write_jsonl(landed.listing_json_from_part(part), path)
    sections = landed.read_sections(spark, path, subject="CS")
    meetings = landed.parse_meetings(landed.meeting_json_from_part(part, sup))
    return landed.assemble_courses(sections, meetings, term_label=SEMESTER)


@register("variants_jsonl", sql=f"""
SELECT template_id, CAST(variant_idx AS BIGINT) AS variant_idx, question FROM {VARIANTS_SQL}""")
def variants_jsonl(spark, sf_dir):
    """K3/K4 + S7: the question variants written as JSON lines and read back."""
    path = work_path(spark, "variants-jsonl")
    v = _variants(spark, sf_dir).select("template_id", "variant_idx", "question")
    landed.write_jsonl(v, path)
    back = spark.read.schema("template_id int, variant_idx bigint, question string").json(path)
    return back


@register("guard_explanations", sql=f"""
WITH f AS (SELECT d.doc_id, d.text, {input_flags_sql('d.text')}, {RELEVANCE_SQL} AS response
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
g AS (SELECT doc_id, text, g_ok AND b_ok AND p_ok AND t_ok AS ok, {INPUT_REASON_SQL} AS reason,
  coalesce(upper(response) = 'RELEVANT', false) AS rel FROM f),
x AS (SELECT doc_id, CASE WHEN NOT ok THEN 'guard' ELSE 'relevance' END AS kind, reason, text FROM g WHERE NOT ok OR NOT rel),
r AS (SELECT doc_id, kind, CASE WHEN kind = 'guard'
    THEN 'The query was blocked by the content guard. Reason: ' || coalesce(reason, '') || chr(10)
      || 'Respond in exactly three lines: status, explanation, suggestion.' || chr(10) || 'Query: ' || text
    ELSE 'The query is not about courses, professors or reviews.' || chr(10)
      || 'Respond in exactly three lines: status, explanation, suggestion.' || chr(10) || 'Query: ' || text END AS prompt,
  upper(kind) || chr(10) || 'Reason: ' || coalesce(reason, '') || chr(10) || 'Ask about a course.' AS response FROM x)
SELECT doc_id, kind, length(prompt) AS prompt_chars, string_split(response, chr(10))[1] AS status,
  string_split(response, chr(10))[2] AS explanation, string_split(response, chr(10))[3] AS suggestion FROM r""")
def guard_explanations(spark, sf_dir):
    """V9: explanation prompts for gate failures and the three-line reply parser
    (replies stand in as status / reason / suggestion lines)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    lab = load(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "NOT RELEVANT")
        .alias("response"))
    g = G.gate(spread(d).join(lab, "doc_id", "left"), "text", "response")
    kind = F.when(~F.col("guard_valid"), F.lit("guard")).otherwise(F.lit("relevance"))
    x = g.select("doc_id", "gate", kind.alias("kind"), "guard_reason", "text")
    prompt = F.when(F.col("kind") == "guard", G.explanation_prompt("guard", "text", "guard_reason")) \
        .otherwise(G.explanation_prompt("relevance", "text"))
    reply = F.concat(F.upper("kind"), F.lit("\nReason: "), F.coalesce("guard_reason", F.lit("")),
                     F.lit("\nAsk about a course."))
    p = x.select("doc_id", "gate", "kind", F.length(prompt).alias("prompt_chars"), G.parse_explanation(reply).alias("e"))
    # written before the filter, which would run every scanner once more below the projections
    p = materialize(p, "guard-explanations").where(F.col("gate") != "VALID")
    return p.select("doc_id", "kind", "prompt_chars", "e.status", "e.explanation", "e.suggestion")
