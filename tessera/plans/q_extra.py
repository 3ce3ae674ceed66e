"""Registered queries: landed detail pages joined into course rows (P10, P11, J1), the
retrievers side by side (R15), chat messages as JSON lines (D4, K3, P17) and the
prompts of all stages (G15, G13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import COURSE_K, SEMESTER
from tessera.functions import html as H
from tessera.functions import render
from tessera.operators import dataset, lexical, stages
from tessera.operators.fuse import context_lists
from tessera.plans import pipelines

from tessera.plans.q_eval import _bm25_sql
from tessera.plans.q_filters import COURSE_DOCS_SQL, course_docs
from tessera.plans.q_rerank import CQ, course_retrieve_sql, review_retrieve_sql
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sq, tfidf_ctes
from tessera.session import work_path
from tessera.sources import landed
from tessera.sources.tables import benchmark_queries, course_queries, load, part_suppliers

# ------------------------------------------------------------------ detail pages

PICKS = {"and_or": 0, "subject": 4, "course_number": 5}


def detail_pages(part):
    """Landed detail pages built from ``part``: a description section and a table of
    0 to 2 prerequisites."""
    def row(cells):
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    none, n = F.lit(""), F.col("p_size") % 3
    first = row([none, none, none, none, F.lit("CS"), (F.lit(5000) + F.col("p_size")).cast("string"), none])
    second = row([F.lit("And"), none, none, none, F.lit("MATH"), (F.lit(1000) + F.col("p_size")).cast("string"), none])
    html = F.concat(F.lit('<html><body><section aria-labelledby="courseDescription">\n <b>'), F.col("p_type"), F.lit("</b> &amp;\n "),
                    F.col("p_brand"), F.lit(' </section><table class="basePreqTable"><thead><tr><th>And/Or</th></tr></thead><tbody>'),
                    F.when(n >= 1, first).otherwise(none), F.when(n == 2, second).otherwise(none), F.lit("</tbody></table></body></html>"))
    return part.select(F.col("p_partkey").cast("string").alias("crn"), html.alias("html"))


def _q(x: str) -> str:
    return f"chr(39) || {x} || chr(39)"


def _prereq_sql(and_or: str, subject: str, number: str) -> str:
    return (f"'{{' || {_q(sq('and_or'))} || ': ' || {_q(sq(and_or))} || ', ' || {_q(sq('subject'))} || ': ' || {_q(sq(subject))} "
            f"|| ', ' || {_q(sq('course_number'))} || ': ' || {_q(number)} || '}}'")


@register("course_details", sql=f"""
SELECT CAST(p_partkey AS VARCHAR) AS crn, p_name AS course_title, p_type || ' & ' || p_brand AS course_description,
  '[' || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN {_prereq_sql('', 'CS', 'CAST(5000 + p_size AS VARCHAR)')}
    ELSE {_prereq_sql('', 'CS', 'CAST(5000 + p_size AS VARCHAR)')} || ', ' || {_prereq_sql('And', 'MATH', 'CAST(1000 + p_size AS VARCHAR)')} END || ']'
    AS prerequisites, {sq(SEMESTER)} AS term FROM part""")
def course_details(spark, sf_dir):
    """P9 + P10 + J1 + P11: descriptions and prerequisite tables read from landed pages,
    joined with listings and meetings into course rows."""
    part = load(spark, sf_dir, "part")
    pages = detail_pages(part)
    descriptions = pages.select("crn", H.element_text("html", "section", "aria-labelledby", "courseDescription").alias("course_description"))
    rows = pages.select("crn", H.table_rows("html", "basePreqTable", PICKS).alias("rows"))
    quoted = lambda name, r: F.concat(F.lit(f"'{name}': '"), r[name], F.lit("'"))
    one = lambda r: F.concat(F.lit("{"), F.concat_ws(", ", *[quoted(n, r) for n in PICKS]), F.lit("}"))
    prerequisites = rows.select("crn", F.concat(F.lit("["), F.array_join(F.transform("rows", one), ", "), F.lit("]")).alias("prerequisites"))
    path = work_path(spark, "detail-listings")
    landed.write_jsonl(landed.listing_json_from_part(part), path)
    meetings = landed.parse_meetings(landed.meeting_json_from_part(part, part_suppliers(spark, sf_dir)))
    out = landed.assemble_courses(landed.read_sections(spark, path), meetings, descriptions, prerequisites, SEMESTER)
    return out.select("crn", "course_title", "course_description", "prerequisites", "term")


# ------------------------------------------------------------------ retrievers side by side

K = 5


@register("retriever_compare", sql=f"""
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, 'tfidf' AS method FROM (WITH {course_retrieve_sql(K)} SELECT * FROM cr)
UNION ALL SELECT query_id, doc_id, rank, 'bm25' FROM ({_bm25_sql()})
UNION ALL SELECT query_id, doc_id, CAST(rank AS INTEGER), 'dense' FROM (WITH {review_retrieve_sql('dv', K, COURSE_DOCS_SQL, CQ, 'h')} SELECT * FROM dv)""")
def retriever_compare(spark, sf_dir):
    """The three retrievers over the same course documents and questions."""
    return pipelines.compare(course_docs(spark, sf_dir), course_queries(spark, sf_dir), K).withColumn("rank", F.col("rank").cast("int"))


# ------------------------------------------------------------------ chat messages

SYSTEM = "You answer questions from the given context."
PROMPT_K = 3


@register("chat_jsonl", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0),
ctx AS (SELECT qid, list(d.text ORDER BY rank) AS docs FROM ranked JOIN documents d ON d.doc_id = ranked.doc_id WHERE rank <= {PROMPT_K} GROUP BY qid),
b AS (SELECT item_id AS query_id, text AS query, coalesce(docs, []) AS docs FROM benchmark LEFT JOIN ctx ON qid = item_id)
SELECT query_id, 0 AS pos, 'system' AS role, {sq(SYSTEM)} AS content FROM b UNION ALL
SELECT query_id, 1, 'user', CASE WHEN len(docs) > 0 THEN 'Context:' || chr(10) || array_to_string(docs, chr(10)) || chr(10) || chr(10) ELSE '' END
  || 'Query: ' || query || chr(10) || chr(10) || 'Answer:' FROM b UNION ALL
SELECT query_id, 2, 'assistant', coalesce(string_split(docs[1], chr(10))[1], '') FROM b""")
def chat_jsonl(spark, sf_dir):
    """D3 + D4 + P17 + K3: (system, user, assistant) messages per benchmark item, with its
    retrieved context, written as JSON lines and read back."""
    docs, q = load(spark, sf_dir, "documents").select("doc_id", "text"), benchmark_queries(spark, sf_dir)
    hits = lexical.search(lexical.fit_tfidf(docs), q, PROMPT_K)
    ctx = context_lists(hits.join(docs, "doc_id"), "query_id", "rank", "text")
    t = dataset.triples(q.withColumnRenamed("query", "question"), ctx)
    t = t.withColumn("user", render.prompt("question", "context"))
    path = work_path(spark, "chat-jsonl")
    landed.write_jsonl(t.select("query_id", dataset.chat_messages(SYSTEM, "user", "response").alias("messages")), path)
    back = spark.read.schema("query_id bigint, messages array<struct<role:string,content:string>>").json(path)
    x = back.select("query_id", F.posexplode("messages").alias("pos", "m"))
    return x.select("query_id", F.col("pos").cast("int"), "m.role", "m.content")


# ------------------------------------------------------------------ prompts of all stages

# Our own wording; a caller passes its own templates.
STAGE_TEMPLATES = {
    "validation": "Query: {query}\n\nIs this about courses? Answer with JSON: is_valid, reason.",
    "intent_analysis": "Query: {query}\n\nWhich fields of both databases are needed? Answer with JSON.",
    "query_enhancement": "Query: {query}\nIntent: {intent}\n\nWrite a search for each database. Answer with JSON.",
    "dynamic_retrieval": "Query: {query}\nIntent: {intent}\n\nSplit {total_k} results between the databases. Answer with JSON.",
    "context_analysis": "Query: {query}\nCourses: {courses}\nReviews: {reviews}\n\nIs this enough? Answer with JSON.",
    "response_generation": "Query: {query}\nIntent: {intent}\nCourses: {courses}\nReviews: {reviews}\n\nAnswer with JSON.",
}


def _slot_sql(t: str) -> str:
    nl = "' || chr(10) || '"
    s = sq(t).replace("\n", nl)
    query = "' || coalesce(CASE WHEN user_id % 31 = 0 THEN NULL ELSE 'How is the ' || event_type || ' course?' END, '') || '"
    intent = f"' || '{{{nl}  \"primary_intent\" : \"' || event_type || '\"{nl}}}' || '"
    courses = "' || '[ ' || CAST(user_id AS VARCHAR) || ' ]' || '"
    return s.replace("{query}", query).replace("{intent}", intent).replace("{courses}", courses).replace("{reviews}", "").replace("{total_k}", str(COURSE_K))


@register("stage_prompts", sql=" UNION ALL ".join(
    f"SELECT event_id AS query_id, {sq(k)} AS stage, {_slot_sql(t)} AS prompt, [{sq(k + ': prompt')}] AS history FROM events"
    for k, t in STAGE_TEMPLATES.items()))
def stage_prompts(spark, sf_dir):
    """G15 + G13: the prompt of each stage for every query (structs and arrays as JSON, a
    missing value as an empty slot), with the history entry appended."""
    e = load(spark, sf_dir, "events")
    query = F.when(F.col("user_id") % 31 != 0, F.concat(F.lit("How is the "), F.col("event_type"), F.lit(" course?")))
    slots = {"query": query, "intent": stages.as_json(F.struct(F.col("event_type").alias("primary_intent"))),
             "courses": stages.as_json(F.array("user_id")), "reviews": stages.as_json(F.lit(None).cast("array<bigint>")),
             "total_k": F.lit(COURSE_K)}
    out = None
    for name, t in STAGE_TEMPLATES.items():
        x = e.select(F.col("event_id").alias("query_id"), F.lit(name).alias("stage"), stages.render_prompt(t, **slots).alias("prompt"),
                     stages.append_history(F.lit(None), F.lit(f"{name}: prompt")).alias("history"))
        out = x if out is None else out.unionByName(x)
    return out
