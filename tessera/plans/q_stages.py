"""Registered staged-pipeline queries (G1-G15) over model outputs derived from ``events``.

The stand-in model outputs are JSON text built per event (a few fixed kinds of
malformed output included), so the parsing, defaults, routing and the retry
loop run over a table that grows with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import (CONTEXT_MAX_ITERATIONS, MAX_ATTEMPTS, MSG_CONTEXT_MAX, MSG_CONTEXT_PARSE,
                            MSG_INTENT_PARSE, MSG_RESPONSE_ERROR, MSG_RESPONSE_MISSING,
                            MSG_RESPONSE_PARSE, MSG_RESPONSE_PARSE_ERROR, MSG_VALIDATION_PARSE, TOTAL_K)
from tessera.operators import lexical
from tessera.operators import stages as G
from tessera.plans.q_filters import COURSE_DOCS_SQL, course_docs
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sq, tfidf_ctes
from tessera.session import materialize
from tessera.sources.tables import benchmark_queries, load

# ----------------------------------------------------------------- stand-in outputs (Spark)


def _b(cond):
    return F.when(cond, F.lit("true")).otherwise(F.lit("false"))


def _s(x):
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def enhanced_output(a: int, et, uid):
    """Sub-queries of attempt ``a``; some outputs are malformed."""
    bad = (et == "purchase") & (uid % 11 == 0) if a == 0 else uid % 17 == 0
    course = F.concat(F.lit("courses about " if a == 0 else f"refined {a} "), et, F.lit(" in boston" if a == 0 else " courses online"))
    review = F.concat(F.lit("the " if a == 0 else f"refined {a} this "), et, F.lit(" of the reviews" if a == 0 else " for"))
    return F.when(bad, F.lit("oops")).otherwise(F.concat(
        F.lit('{"course_db_query": "'), course, F.lit('", "review_db_query": "'), review,
        F.lit('", "enhancement_reasoning": "r", "focus_aspects": ["'), et, F.lit('"]}')))


def model_outputs(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    et, uid, v, eid = F.col("event_type"), F.col("user_id"), F.col("value"), F.col("event_id")
    rows = []
    val = (F.when(et == "error", F.lit("Sorry, I cannot do that"))
           .when(et == "signup", F.lit('{"reason": "missing flag"}'))
           .otherwise(F.concat(F.lit('{"is_valid": '), _b(v >= 10), F.lit(', "reason": "'), et, F.lit('"}'))))
    rows.append(e.select(eid.alias("query_id"), F.lit("validation").alias("stage"), F.lit(0).alias("attempt"),
                         val.alias("response")))
    intent = (F.when((et == "view") & (v < 5), F.lit("not json {"))
              .when(uid % 19 == 0, F.lit('{"primary_intent": "x", "required_fields": {"course_db": []}}'))
              .when(uid % 23 == 0, F.lit('[1]'))
              .otherwise(F.concat(
                  F.lit('{"primary_intent": "'), et, F.lit('", "required_fields": {"course_db": '),
                  F.when(uid % 2 == 0, F.lit('["title"]')).otherwise(F.lit("[]")), F.lit(', "review_db": '),
                  F.when(uid % 3 == 0, F.lit('["rating"]')).otherwise(F.lit("[]")),
                  F.lit('}, "priority": {"course_info_weight": '), _s(uid % 5),
                  F.lit(', "review_info_weight": '), _s(uid % 4),
                  F.lit('}, "specific_aspects": [], "reasoning": "r"}'))))
    rows.append(e.select(eid.alias("query_id"), F.lit("intent").alias("stage"), F.lit(0).alias("attempt"),
                         intent.alias("response")))
    for a in range(MAX_ATTEMPTS):
        ck = (uid + a) % 9 + 1
        strat = (F.when((et == "purchase") & F.lit(a == 0),
                        F.lit('```json {"course_k": 3, "review_k": 12} ```'))
                 .otherwise(F.concat(F.lit('{"course_k": '), _s(ck), F.lit(', "review_k": '), _s(F.lit(15) - ck),
                                     F.lit(', "reasoning": "x", "priority_source": "balanced"}'))))
        ctx = (F.when((et == "click") & F.lit(a == 1), F.lit("oops"))
               .otherwise(F.concat(F.lit('{"is_sufficient": '), _b((eid + a) % 4 == 0),
                                   F.lit(', "missing_aspects": [], "has_partial_info": true, "unanswerable": '),
                                   _b(uid % 13 == 0), F.lit(', "feedback": {"retrieval_suggestions": {"course_k": '),
                                   _s(uid % 7), F.lit(', "review_k": null}}, "analysis_reasoning": "a"}'))))
        rows.append(e.select(eid.alias("query_id"), F.lit("enhancement").alias("stage"), F.lit(a).alias("attempt"),
                             enhanced_output(a, et, uid).alias("response")))
        rows.append(e.select(eid.alias("query_id"), F.lit("strategy").alias("stage"), F.lit(a).alias("attempt"),
                             strat.alias("response")))
        rows.append(e.select(eid.alias("query_id"), F.lit("context").alias("stage"), F.lit(a).alias("attempt"),
                             ctx.alias("response")))
    resp = (F.when(et == "error", F.lit("I could not produce JSON"))
            .when(uid % 29 == 0, F.lit('{"has_limitations": true}'))
            .otherwise(F.concat(F.lit('{"response": "Answer '), _s(eid), F.lit('", "has_limitations": '),
                                _b(v > 50), F.lit(', "limitation_notes": ["few reviews", "old data"], '
                                                  '"additional_suggestions": '),
                                F.when(uid % 2 == 0, F.lit('["see advisor", "check prerequisites"]'))
                                .otherwise(F.lit("[]")), F.lit("}"))))
    rows.append(e.select(eid.alias("query_id"), F.lit("response").alias("stage"), F.lit(0).alias("attempt"),
                         resp.alias("response")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def agent_queries(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("query_id"),
                    F.concat(F.lit("How is the "), F.col("event_type"), F.lit(" course?")).alias("query"))


# ----------------------------------------------------------------- the same in SQL


def _bs(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 'true' ELSE 'false' END)"


VAL_SQL = ("(CASE WHEN event_type = 'error' THEN 'Sorry, I cannot do that' WHEN event_type = 'signup' "
           "THEN '{\"reason\": \"missing flag\"}' ELSE '{\"is_valid\": ' || " + _bs("value >= 10") +
           " || ', \"reason\": \"' || event_type || '\"}' END)")
INTENT_SQL = ("(CASE WHEN event_type = 'view' AND value < 5 THEN 'not json {' "
              "WHEN user_id % 19 = 0 THEN '{\"primary_intent\": \"x\", \"required_fields\": {\"course_db\": []}}' "
              "WHEN user_id % 23 = 0 THEN '[1]' ELSE "
              "'{\"primary_intent\": \"' || event_type || '\", \"required_fields\": {\"course_db\": ' || "
              "(CASE WHEN user_id % 2 = 0 THEN '[\"title\"]' ELSE '[]' END) || ', \"review_db\": ' || "
              "(CASE WHEN user_id % 3 = 0 THEN '[\"rating\"]' ELSE '[]' END) || "
              "'}, \"priority\": {\"course_info_weight\": ' || CAST(user_id % 5 AS VARCHAR) || "
              "', \"review_info_weight\": ' || CAST(user_id % 4 AS VARCHAR) || "
              "'}, \"specific_aspects\": [], \"reasoning\": \"r\"}' END)")


def strat_sql(a: int) -> str:
    ck = f"((user_id + {a}) % 9 + 1)"
    return (f"(CASE WHEN event_type = 'purchase' AND {str(a == 0).lower()} THEN "
            f"'```json {{\"course_k\": 3, \"review_k\": 12}} ```' ELSE '{{\"course_k\": ' || CAST({ck} AS VARCHAR) || "
            f"', \"review_k\": ' || CAST(15 - {ck} AS VARCHAR) || ', \"reasoning\": \"x\", \"priority_source\": \"balanced\"}}' END)")


def ctx_sql(a: int) -> str:
    return (f"(CASE WHEN event_type = 'click' AND {str(a == 1).lower()} THEN 'oops' ELSE "
            f"'{{\"is_sufficient\": ' || {_bs(f'(event_id + {a}) % 4 = 0')} || "
            f"', \"missing_aspects\": [], \"has_partial_info\": true, \"unanswerable\": ' || {_bs('user_id % 13 = 0')} || "
            f"', \"feedback\": {{\"retrieval_suggestions\": {{\"course_k\": ' || CAST(user_id % 7 AS VARCHAR) || "
            f"', \"review_k\": null}}}}, \"analysis_reasoning\": \"a\"}}' END)")


def any_json_sql(r: str) -> str:
    return f"(coalesce(json_valid({r}), false) AND regexp_matches({r}, '(?s)^\\s*[{{\\[].*[}}\\]]\\s*$'))"


def strict_sql(r: str) -> str:
    return f"({any_json_sql(r)} AND starts_with(trim({r}), '{{'))"


def enhanced_sql(a: int, source: str) -> str:
    """The sub-query that a well-formed output of attempt ``a`` holds."""
    if source == "course":
        return "'courses about ' || event_type || ' in boston'" if a == 0 else f"'refined {a} ' || event_type || ' courses online'"
    return "'the ' || event_type || ' of the reviews'" if a == 0 else f"'refined {a} this ' || event_type || ' for'"


ENHANCED_OK_SQL = "NOT (event_type = 'purchase' AND user_id % 11 = 0)"


@register("parse_validation", sql=f"""
WITH o AS (SELECT event_id AS query_id, {VAL_SQL} AS r FROM events)
SELECT query_id,
  CASE WHEN NOT {strict_sql('r')} THEN false ELSE coalesce(CAST(json_extract(r, '$.is_valid') AS BOOLEAN), false) END AS valid,
  CASE WHEN NOT {strict_sql('r')} THEN {sq(MSG_VALIDATION_PARSE)}
       WHEN json_extract(r, '$.is_valid') IS NULL THEN 'Validation error: ''is_valid'''
       ELSE coalesce(json_extract_string(r, '$.reason'), '') END AS reason FROM o""")
def parse_validation(spark, sf_dir):
    """G1 over every query."""
    v = G.validation(agent_queries(spark, sf_dir), model_outputs(spark, sf_dir))
    return v.select("query_id", "valid", "reason")


@register("intent_routing", sql=f"""
WITH o0 AS (SELECT event_id AS query_id, {INTENT_SQL} AS r FROM events),
o AS (SELECT *, CASE WHEN {strict_sql('r')} THEN r END AS rj FROM o0),
p AS (SELECT query_id, {strict_sql('r')} AS ok, {any_json_sql('r')} AS js,
  json_extract(rj, '$.required_fields') AS rf, json_extract(rj, '$.priority') AS pr, json_array_length(rj, '$.required_fields.course_db') AS nc, json_array_length(rj, '$.required_fields.review_db') AS nr,
  CAST(json_extract(rj, '$.priority.course_info_weight') AS DOUBLE) AS cw,
  CAST(json_extract(rj, '$.priority.review_info_weight') AS DOUBLE) AS rw FROM o),
q AS (SELECT *, ok AND nc IS NOT NULL AND nr IS NOT NULL AND cw IS NOT NULL AND rw IS NOT NULL AS complete FROM p)
SELECT query_id, CASE WHEN complete THEN nc > 0 END AS needs_course_info,
  CASE WHEN complete THEN nr > 0 END AS needs_reviews,
  CASE WHEN complete THEN (CASE WHEN cw > rw THEN 'course_db' ELSE 'review_db' END) END AS priority_source,
  CASE WHEN NOT js THEN {sq(MSG_INTENT_PARSE)} WHEN complete THEN NULL
    WHEN NOT ok THEN 'Intent analysis error: list indices must be integers or slices, not str'
    ELSE 'Intent analysis error: ' || chr(39) || CASE WHEN rf IS NULL THEN 'required_fields' WHEN nc IS NULL THEN 'course_db'
      WHEN nr IS NULL THEN 'review_db' WHEN pr IS NULL THEN 'priority' WHEN cw IS NULL THEN 'course_info_weight'
      ELSE 'review_info_weight' END || chr(39) END AS error FROM q""")
def intent_routing(spark, sf_dir):
    """G2 + G3: routing facts; malformed output -> error."""
    v = G.intent(agent_queries(spark, sf_dir), model_outputs(spark, sf_dir))
    return v.select("query_id", "needs_course_info", "needs_reviews", "priority_source", "error")


def _verdicts_sql() -> str:
    parts = []
    for a in range(MAX_ATTEMPTS):
        parts.append(f"""SELECT event_id AS query_id, {a} AS attempt, {ctx_sql(a)} AS r, {strat_sql(a)} AS sr FROM events""")
    return f"""o0 AS ({' UNION ALL '.join(parts)}),
o AS (SELECT *, CASE WHEN {strict_sql('r')} THEN r END AS rj, CASE WHEN {strict_sql('sr')} THEN sr END AS srj FROM o0),
p AS (SELECT query_id, attempt, {strict_sql('r')} AS ok, CAST(json_extract(rj, '$.is_sufficient') AS BOOLEAN) AS s,
  CAST(json_extract(rj, '$.unanswerable') AS BOOLEAN) AS u,
  CASE WHEN json_extract(srj, '$.course_k') IS NOT NULL AND json_extract(srj, '$.review_k') IS NOT NULL
    THEN CAST(json_extract(srj, '$.course_k') AS INTEGER) ELSE 5 END AS course_k,
  CASE WHEN json_extract(srj, '$.course_k') IS NOT NULL AND json_extract(srj, '$.review_k') IS NOT NULL
    THEN CAST(json_extract(srj, '$.review_k') AS INTEGER) ELSE 5 END AS review_k FROM o),
vd AS (SELECT query_id, attempt, course_k, review_k,
  CASE WHEN course_k + review_k > 0 THEN (CASE WHEN attempt >= {CONTEXT_MAX_ITERATIONS} OR NOT ok THEN true ELSE coalesce(s, false) END) END AS is_sufficient,
  CASE WHEN course_k + review_k > 0 THEN (CASE WHEN attempt >= {CONTEXT_MAX_ITERATIONS} OR NOT ok THEN false ELSE coalesce(u, false) END) END AS unanswerable,
  CASE WHEN course_k + review_k > 0 THEN (CASE WHEN attempt >= {CONTEXT_MAX_ITERATIONS} THEN {sq(MSG_CONTEXT_MAX)}
    WHEN NOT ok THEN {sq(MSG_CONTEXT_PARSE)} END) END AS context_note FROM p),
vn AS (SELECT *, coalesce(NOT is_sufficient AND NOT unanswerable, false) AS needs_improvement FROM vd)"""


@register("context_verdict", sql=f"""WITH {_verdicts_sql()}
SELECT query_id, CAST(attempt AS INTEGER) AS attempt, is_sufficient, unanswerable, needs_improvement, context_note FROM vn""")
def context_verdict(spark, sf_dir):
    """G6 + G9 for every query and attempt (n_retrieved = course_k + review_k)."""
    q = agent_queries(spark, sf_dir)
    out = model_outputs(spark, sf_dir)
    parts = []
    for a in range(MAX_ATTEMPTS):
        s = G.strategy(q, out, a).withColumn("n_retrieved", F.col("course_k") + F.col("review_k"))
        parts.append(G.context_verdict(s, out, a).withColumn("attempt", F.lit(a)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res.select("query_id", F.col("attempt").cast("int"), "is_sufficient", "unanswerable",
                      "needs_improvement", "context_note")


def _hits_sql(name: str, docs: str, texts: str) -> str:
    """CTE ``name``(q, n): how many documents (TOTAL_K at most) each distinct sub-query finds."""
    return f"""{name} AS (SELECT q, least(count(*), {TOTAL_K}) AS n FROM (WITH {tfidf_ctes(docs, 'doc_id', 'text', texts, 'q', 'q')}
  SELECT qid AS q, doc_id FROM scores WHERE score > 0) GROUP BY q)"""


def _loop_sql() -> str:
    """CTEs ending in ``ended``: the row of each enhanced query's last attempt."""
    def chain(a: int, source: str) -> str:
        return enhanced_sql(0, source) if a == 0 else f"(CASE WHEN user_id % 17 = 0 THEN {chain(a - 1, source)} ELSE {enhanced_sql(a, source)} END)"
    sub = {s: " UNION ".join(f"SELECT {chain(a, s)} AS q FROM ev" for a in range(MAX_ATTEMPTS)) for s in ("course", "review")}
    attempts = " UNION ALL ".join(f"SELECT query_id, user_id, {a} AS attempt, {chain(a, 'course')} AS cq, {chain(a, 'review')} AS rq, "
                                  f"{ctx_sql(a)} AS r, {strat_sql(a)} AS sr FROM ev" for a in range(MAX_ATTEMPTS))
    ks = "json_extract(srj, '$.course_k') IS NOT NULL AND json_extract(srj, '$.review_k') IS NOT NULL"
    return f"""ev AS (SELECT *, event_id AS query_id FROM events WHERE {ENHANCED_OK_SQL}),
cd AS {COURSE_DOCS_SQL}, tc AS ({sub['course']}), tr AS ({sub['review']}),
{_hits_sql('hc', 'cd', 'tc')}, {_hits_sql('hr', 'documents', 'tr')},
o0 AS ({attempts}),
o AS (SELECT *, CASE WHEN {strict_sql('r')} THEN r END AS rj, CASE WHEN {strict_sql('sr')} THEN sr END AS srj FROM o0),
p AS (SELECT query_id, user_id, attempt, cq, rq, {strict_sql('r')} AS ok, CAST(json_extract(rj, '$.is_sufficient') AS BOOLEAN) AS s,
  CAST(json_extract(rj, '$.unanswerable') AS BOOLEAN) AS u,
  CASE WHEN {ks} THEN CAST(json_extract(srj, '$.course_k') AS INTEGER) ELSE 5 END AS course_k,
  CASE WHEN {ks} THEN CAST(json_extract(srj, '$.review_k') AS INTEGER) ELSE 5 END AS review_k FROM o),
rt AS (SELECT p.*, least(course_k, coalesce(hc.n, 0)) AS n_course, least(review_k, coalesce(hr.n, 0)) AS n_review
  FROM p LEFT JOIN hc ON hc.q = cq LEFT JOIN hr ON hr.q = rq),
vd AS (SELECT *, CASE WHEN n_course + n_review > 0 THEN attempt >= {CONTEXT_MAX_ITERATIONS} OR NOT ok OR coalesce(s, false) END AS is_sufficient,
  CASE WHEN n_course + n_review > 0 THEN NOT (attempt >= {CONTEXT_MAX_ITERATIONS} OR NOT ok) AND coalesce(u, false) END AS unanswerable FROM rt),
st AS (SELECT *, coalesce(unanswerable, false) OR NOT coalesce(NOT is_sufficient AND NOT unanswerable, false)
  OR attempt >= {MAX_ATTEMPTS - 1} AS stop FROM vd),
first_stop AS (SELECT query_id, min(attempt) AS a FROM st WHERE stop GROUP BY query_id),
ended AS (SELECT st.*, attempt > 0 AND user_id % 17 = 0 AS refine_failed FROM st JOIN first_stop f ON f.query_id = st.query_id AND f.a = st.attempt)"""


def _searched(spark, sf_dir, out):
    """``retrieve`` over both sources: the distinct sub-queries of all attempts are searched
    once in the course documents and once in the documents (TF-IDF, TOTAL_K hits each)."""
    texts = G.parsed(out.where(F.col("stage") == "enhancement"), G.ENHANCEMENT)
    texts = texts.select(F.col("_p")["course_db_query"].alias("c"), F.col("_p")["review_db_query"].alias("r"))
    texts = materialize(texts.distinct(), "sub-queries")

    def hits(docs, col):
        q = texts.select(F.col(col).alias("query")).where(F.col("query").isNotNull()).distinct()
        found = lexical.search(lexical.fit_tfidf(docs), q.select("query", F.col("query").alias("text")), TOTAL_K, "query", "text")
        return found.select("query", "doc_id", "rank")
    return G.retriever(hits(course_docs(spark, sf_dir), "c"), hits(load(spark, sf_dir, "documents"), "r"))


@register("retry_loop", sql=f"""WITH {_loop_sql()}
SELECT query_id, CAST(attempt + 1 AS INTEGER) AS attempts, course_k, review_k, CAST(n_course AS INTEGER) AS n_course,
  CAST(n_review AS INTEGER) AS n_review, is_sufficient, unanswerable, refine_failed FROM ended""")
def retry_loop(spark, sf_dir):
    """Enhanced queries through the bounded loop, each attempt searching both sources
    with its own k and refining the sub-queries of what stays open."""
    out = materialize(model_outputs(spark, sf_dir), "model-outputs")
    q = materialize(G.enhancement(G.attach_outputs(agent_queries(spark, sf_dir), out)), "enhanced")
    res = G.retry_loop(q.where(F.col("error").isNull()), None, _searched(spark, sf_dir, out))
    return res.select("query_id", F.col("attempts").cast("int"), "course_k", "review_k", F.size("course_info").alias("n_course"),
                      F.size("review_info").alias("n_review"), "is_sufficient", "unanswerable",
                      F.col("error").isNotNull().alias("refine_failed"))


RESP_SQL = ("(CASE WHEN event_type = 'error' THEN 'I could not produce JSON' "
            "WHEN user_id % 29 = 0 THEN '{\"has_limitations\": true}' ELSE "
            "'{\"response\": \"Answer ' || CAST(event_id AS VARCHAR) || '\", \"has_limitations\": ' || "
            + _bs("value > 50") + " || ', \"limitation_notes\": [\"few reviews\", \"old data\"], "
            "\"additional_suggestions\": ' || (CASE WHEN user_id % 2 = 0 THEN "
            "'[\"see advisor\", \"check prerequisites\"]' ELSE '[]' END) || '}' END)")


BODY_SQL = """json_extract_string(r, '$.response')
    || coalesce(CASE WHEN coalesce(CAST(json_extract(r, '$.has_limitations') AS BOOLEAN), false) THEN
         chr(10) || chr(10) || 'Note: ' || array_to_string(CAST(json_extract(r, '$.limitation_notes') AS VARCHAR[]), ', ') END, '')
    || coalesce(CASE WHEN json_array_length(r, '$.additional_suggestions') > 0 THEN
         chr(10) || chr(10) || 'Additional suggestions:' || chr(10) || '- ' ||
         array_to_string(CAST(json_extract(r, '$.additional_suggestions') AS VARCHAR[]), chr(10) || '- ') END, '')"""
LACKING_SQL = f"({any_json_sql('r')} AND json_extract_string(r, '$.response') IS NULL)"


@register("response_format", sql=f"""
WITH o AS (SELECT event_id AS query_id, {RESP_SQL} AS r FROM events)
SELECT query_id, CASE WHEN query_id % 10 = 3 THEN {sq(MSG_RESPONSE_MISSING)} WHEN NOT {any_json_sql('r')} THEN {sq(MSG_RESPONSE_PARSE)}
    WHEN {LACKING_SQL} THEN {sq(MSG_RESPONSE_ERROR)} ELSE {BODY_SQL} END AS final_response,
  CASE WHEN query_id % 10 = 3 THEN NULL WHEN NOT {any_json_sql('r')} THEN {sq(MSG_RESPONSE_PARSE_ERROR)}
    WHEN {LACKING_SQL} THEN 'Response generation error: ' || chr(39) || 'response' || chr(39) END AS response_error FROM o""")
def response_format(spark, sf_dir):
    """Formatted final response per query; some queries come without retrieved context."""
    q = agent_queries(spark, sf_dir).withColumn("n_retrieved", F.when(F.col("query_id") % 10 == 3, 0).otherwise(1))
    r = G.response(q.withColumn("is_sufficient", F.lit(True)), model_outputs(spark, sf_dir))
    return r.select("query_id", "final_response", "response_error")


DK_SQL_STRAT = "(CASE WHEN item_id % 5 = 0 THEN 'not json' ELSE '{\"course_k\": ' || CAST(item_id % 7 + 1 AS VARCHAR) || ', \"review_k\": 3}' END)"


@register("dynamic_k_topk", sql=f"""
WITH {tfidf_ctes('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')},
k0 AS (SELECT item_id, {DK_SQL_STRAT} AS sr0 FROM benchmark),
k AS (SELECT item_id, CASE WHEN {strict_sql('sr0')} THEN sr0 END AS sr FROM k0),
kk AS (SELECT item_id, CASE WHEN json_extract(sr, '$.course_k') IS NOT NULL
  AND json_extract(sr, '$.review_k') IS NOT NULL THEN CAST(json_extract(sr, '$.course_k') AS INTEGER) ELSE 5 END AS course_k FROM k),
ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT qid AS query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, course_k FROM ranked JOIN kk ON kk.item_id = ranked.qid
WHERE rank <= course_k""")
def dynamic_k_topk(spark, sf_dir):
    """G6 + G7: each query has its own k (from the strategy output; malformed -> 5)."""
    q = benchmark_queries(spark, sf_dir)
    strat = q.select("query_id", F.when(F.col("query_id") % 5 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"course_k": '), (F.col("query_id") % 7 + 1).cast("string"), F.lit(', "review_k": 3}')))
        .alias("response")).withColumn("stage", F.lit("strategy")).withColumn("attempt", F.lit(0))
    ks = G.strategy(q.select("query_id"), strat, 0).select("query_id", "course_k")
    # both sources together never ask for more than TOTAL_K: a top-k by that bound first
    s = lexical.search(lexical.fit_tfidf(load(spark, sf_dir, "documents")), q, TOTAL_K).join(ks, "query_id")
    return s.where(F.col("rank") <= F.col("course_k")).select(
        "query_id", "doc_id", "score", "rank", "course_k")


#: Most documents of a source that an adjusted retrieval asks for in ``capped_k``.
ADJUSTED_CAP = 4


@register("capped_k", sql=f"""
WITH k0 AS (SELECT item_id, {DK_SQL_STRAT} AS sr0 FROM benchmark),
k AS (SELECT item_id, CASE WHEN {strict_sql('sr0')} THEN sr0 END AS sr FROM k0),
kk AS (SELECT item_id, json_extract(sr, '$.course_k') IS NOT NULL AND json_extract(sr, '$.review_k') IS NOT NULL AS ok, sr FROM k)
SELECT item_id AS query_id, least(CASE WHEN ok THEN CAST(json_extract(sr, '$.course_k') AS INTEGER) ELSE 5 END, {ADJUSTED_CAP}) AS course_k,
  least(CASE WHEN ok THEN CAST(json_extract(sr, '$.review_k') AS INTEGER) ELSE 5 END, {ADJUSTED_CAP}) AS review_k FROM kk""")
def capped_k(spark, sf_dir):
    """Each query's k for either source, limited to the cap of an adjusted retrieval."""
    q = benchmark_queries(spark, sf_dir)
    strat = q.select("query_id", F.when(F.col("query_id") % 5 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"course_k": '), (F.col("query_id") % 7 + 1).cast("string"), F.lit(', "review_k": 3}')))
        .alias("response")).withColumn("stage", F.lit("strategy")).withColumn("attempt", F.lit(0))
    return G.strategy(q.select("query_id"), strat, 0, cap=ADJUSTED_CAP).select("query_id", "course_k", "review_k")


ERR = "'I apologize, but I encountered an error: ' || {m} || '. Please try rephrasing your question.'"


def _staged_sql() -> str:
    def error(m: str, stage: str, source: str) -> str:
        return (f"SELECT query_id, {ERR.format(m=m)} AS final_response, '{stage}' AS stage, ['Error: ' || {m}] AS processing_history, "
                f"CAST(NULL AS INTEGER) AS attempts, CAST(NULL AS INTEGER) AS n_course, CAST(NULL AS INTEGER) AS n_review FROM {source}")
    return f"""WITH {_loop_sql()},
base AS (SELECT event_id AS query_id, {VAL_SQL} AS v, {INTENT_SQL} AS it, {RESP_SQL} AS r, {ENHANCED_OK_SQL} AS enh FROM events),
f AS (SELECT *, {strict_sql('v')} AS vjs,
  CASE WHEN {strict_sql('v')} THEN coalesce(CAST(json_extract(v, '$.is_valid') AS BOOLEAN), false) ELSE false END AS valid,
  {strict_sql('it')} AND coalesce(json_extract(it, '$.required_fields.review_db') IS NOT NULL
    AND json_extract(it, '$.priority.review_info_weight') IS NOT NULL, false) AS intent_ok FROM base),
inv AS (SELECT query_id, 'Invalid query: ' || CASE WHEN NOT vjs THEN {sq(MSG_VALIDATION_PARSE)}
  WHEN json_extract(v, '$.is_valid') IS NULL THEN 'Validation error: ' || chr(39) || 'is_valid' || chr(39) ELSE coalesce(json_extract_string(v, '$.reason'), '') END AS m
  FROM f WHERE NOT valid),
run AS (SELECT f.query_id, r, attempt, n_course, n_review, is_sufficient, refine_failed FROM f JOIN ended USING (query_id) WHERE valid AND intent_ok),
ans AS (SELECT *, n_course + n_review = 0 OR is_sufficient IS NULL AS missing FROM run),
fin AS (SELECT *, refine_failed OR (NOT missing AND (NOT {any_json_sql('r')} OR {LACKING_SQL})) AS bad FROM ans)
{error('m', 'validation', 'inv')} UNION ALL
{error("'Error analyzing query intent'", 'intent_analysis', '(SELECT query_id FROM f WHERE valid AND NOT intent_ok)')} UNION ALL
{error("'Error enhancing query'", 'query_enhancement', '(SELECT query_id FROM f WHERE valid AND intent_ok AND NOT enh)')} UNION ALL
SELECT query_id, CASE WHEN bad THEN {ERR.format(m="'Error generating response'")} WHEN missing THEN {sq(MSG_RESPONSE_MISSING)} ELSE {BODY_SQL} END,
  'response_generation', CASE WHEN bad THEN ['Error: Error generating response'] ELSE [] END, CAST(attempt + 1 AS INTEGER),
  CAST(n_course AS INTEGER), CAST(n_review AS INTEGER) FROM fin"""


@register("staged_pipeline", sql=_staged_sql())
def staged_pipeline(spark, sf_dir):
    """Validation -> intent -> enhancement -> retry loop (searching both sources) ->
    response; a failure of a stage, or of a refinement, ends the query with the standard
    error response and a history entry (G12, G13)."""
    out = materialize(model_outputs(spark, sf_dir), "model-outputs")
    state = agent_queries(spark, sf_dir).withColumn("processing_history", F.array().cast("array<string>"))
    # the first stages read every query's outputs once; where a query ends is a filter on what they wrote
    v = G.validation(G.attach_outputs(state, out), None)
    it = G.intent(v, None).withColumnRenamed("error", "intent_error")
    en = materialize(G.enhancement(it), "staged")
    understood = en.where("valid and intent_error is null").drop("intent_error")
    ends = [G.failed(en.where("not valid"), F.concat(F.lit("Invalid query: "), F.col("reason")), "validation"),
            G.failed(en.where("valid and intent_error is not null"), "Error analyzing query intent", "intent_analysis"),
            G.failed(understood.where("error is not null"), "Error enhancing query", "query_enhancement")]
    looped = G.retry_loop(understood.where("error is null"), None, _searched(spark, sf_dir, out))
    r = G.response(looped, None)
    bad = F.col("error").isNotNull() | F.col("response_error").isNotNull()
    m = F.lit("Error generating response")
    done = r.select("query_id", F.when(bad, G.error_response(m)).otherwise(F.col("final_response")).alias("final_response"),
                    F.lit("response_generation").alias("stage"),
                    F.when(bad, G.append_history("processing_history", F.concat(F.lit("Error: "), m)))
                    .otherwise(F.col("processing_history")).alias("processing_history"),
                    "attempts", F.size("course_info").alias("n_course"), F.size("review_info").alias("n_review"))
    for e in ends:
        done = done.unionByName(e, allowMissingColumns=True)
    return done
