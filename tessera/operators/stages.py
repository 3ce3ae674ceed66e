"""Staged query processing over a table of model outputs.

The model calls of each stage are outside this engine: their outputs arrive as
``model_outputs(query_id, stage, attempt, response)`` (from a pluggable
generator or a precomputed table). Here we parse them (strictly, like a JSON
loader), apply the documented defaults, route, loop and assemble, for all
queries at once. The state is a wide DataFrame keyed by ``query_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import (CONTEXT_MAX_ITERATIONS, DEFAULT_COURSE_K, DEFAULT_REVIEW_K,
                            MAX_ATTEMPTS, MSG_CONTEXT_MAX, MSG_CONTEXT_PARSE, MSG_ENHANCEMENT_PARSE,
                            MSG_INTENT_PARSE, MSG_JSON_ARRAY, MSG_RESPONSE_ERROR, MSG_RESPONSE_MISSING,
                            MSG_RESPONSE_PARSE, MSG_RESPONSE_PARSE_ERROR, MSG_STRATEGY_DEFAULT,
                            MSG_VALIDATION_PARSE)
from tessera.session import materialize

S, B, I, D = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
ARR = T.ArrayType(S)
VALIDATION = T.StructType([T.StructField("is_valid", B), T.StructField("reason", S)])
INTENT = T.StructType([
    T.StructField("primary_intent", S),
    T.StructField("required_fields", T.StructType([T.StructField("course_db", ARR),
                                                   T.StructField("review_db", ARR)])),
    T.StructField("priority", T.StructType([T.StructField("course_info_weight", D),
                                            T.StructField("review_info_weight", D)])),
    T.StructField("specific_aspects", ARR), T.StructField("reasoning", S)])
ENHANCEMENT = T.StructType([T.StructField("course_db_query", S), T.StructField("review_db_query", S),
                            T.StructField("enhancement_reasoning", S), T.StructField("focus_aspects", ARR)])
STRATEGY = T.StructType([T.StructField("course_k", I), T.StructField("review_k", I),
                         T.StructField("reasoning", S), T.StructField("priority_source", S)])
CONTEXT = T.StructType([T.StructField("is_sufficient", B), T.StructField("missing_aspects", ARR),
                        T.StructField("has_partial_info", B), T.StructField("unanswerable", B),
                        T.StructField("feedback", T.StructType([
                            T.StructField("query_suggestions", T.StructType([T.StructField("course_db", S),
                                                                             T.StructField("review_db", S)])),
                            T.StructField("retrieval_suggestions", T.StructType([
                                T.StructField("course_k", I), T.StructField("review_k", I),
                                T.StructField("reasoning", S)]))])),
                        T.StructField("analysis_reasoning", S)])
RESPONSE = T.StructType([T.StructField("response", S), T.StructField("has_limitations", B),
                         T.StructField("limitation_notes", ARR),
                         T.StructField("additional_suggestions", ARR)])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_json(response) -> Column:
    """Q12: parses as JSON (no trailing text) and is an object or array."""
    r = _c(response)
    return F.coalesce(F.try_parse_json(r).isNotNull() & r.rlike(r"(?s)^\s*[\{\[].*[\}\]]\s*$"),
                      F.lit(False))


def is_object(response) -> Column:
    return F.coalesce(F.trim(_c(response)).startswith("{"), F.lit(False))


def parsed(x: DataFrame, schema: T.StructType) -> DataFrame:
    """``x`` with its ``response`` read once: ``_json`` (strict JSON) and ``_p`` (the object, NULL
    if malformed). Both are projections of their own: a column that is used several times
    isn't inlined, so the parsers run once a row however many fields are taken."""
    x = x.withColumn("_json", strict_json("response"))
    return x.withColumn("_p", F.when(F.col("_json") & is_object("response"), F.from_json("response", schema)))


OUTPUTS = "_outputs"


def attach_outputs(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """The state with all outputs of a query in one map column ("stage:attempt" ->
    response): stages then read a column instead of joining once each. A query has a
    bounded number of outputs (stages x attempts)."""
    key = F.concat_ws(":", "stage", F.col("attempt").cast("string"))
    per_query = outputs.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "response"))).alias(OUTPUTS))
    none = F.create_map().cast("map<string,string>")
    return state.join(per_query, "query_id", "left").withColumn(OUTPUTS, F.coalesce(OUTPUTS, none))


def with_response(state: DataFrame, outputs: DataFrame | None, stage: str, attempt: int = 0) -> DataFrame:
    """The state and the stage's ``response``, from the attached map or by a join."""
    if OUTPUTS in state.columns:
        return state.withColumn("response", F.col(OUTPUTS)[f"{stage}:{attempt}"])
    mine = outputs.where((F.col("stage") == stage) & (F.col("attempt") == attempt)).select("query_id", "response")
    return state.join(mine, "query_id", "left")


def missing_key(response, present: list[tuple[str, Column]], prefix: str) -> Column:
    """Error of valid JSON (of ``parsed`` rows) that lacks a key: the first one missing, as a lookup would say."""
    out = F.when(F.col("_json") & ~is_object(response), F.lit(prefix + MSG_JSON_ARRAY))
    for key, value in present:
        out = out.when(value.isNull(), F.lit(f"{prefix}'{key}'"))
    return out


def validation(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """G1: valid/reason; malformed -> invalid + fixed message; key missing -> 'Validation error: ...'."""
    x = parsed(with_response(state, outputs, "validation", 0), VALIDATION)
    p = F.col("_p")
    ok = F.col("_json") & is_object("response")
    return x.select(*state.columns,
                    F.when(~ok, F.lit(False)).otherwise(F.coalesce(p["is_valid"], F.lit(False))).alias("valid"),
                    F.when(~ok, F.lit(MSG_VALIDATION_PARSE))
                    .when(p["is_valid"].isNull(), F.lit("Validation error: 'is_valid'"))
                    .otherwise(F.coalesce(p["reason"], F.lit(""))).alias("reason"))


def intent(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """G2 + G3: intent analysis and routing facts; malformed output or a missing key -> NULL + error."""
    x = parsed(with_response(state, outputs, "intent", 0), INTENT)
    p = F.col("_p")
    cw, rw = p["priority"]["course_info_weight"], p["priority"]["review_info_weight"]
    complete = p.isNotNull() & p["required_fields"]["course_db"].isNotNull() & \
        p["required_fields"]["review_db"].isNotNull() & cw.isNotNull() & rw.isNotNull()
    return x.select(*state.columns, F.when(complete, p).alias("intent_analysis"),
                    F.when(complete, F.size(p["required_fields"]["course_db"]) > 0).alias("needs_course_info"),
                    F.when(complete, F.size(p["required_fields"]["review_db"]) > 0).alias("needs_reviews"),
                    F.when(complete, F.when(cw > rw, F.lit("course_db")).otherwise(F.lit("review_db")))
                    .alias("priority_source"),
                    F.when(~F.col("_json"), F.lit(MSG_INTENT_PARSE)).otherwise(missing_key(
                        "response", [("required_fields", p["required_fields"]), ("course_db", p["required_fields"]["course_db"]),
                                     ("review_db", p["required_fields"]["review_db"]), ("priority", p["priority"]),
                                     ("course_info_weight", cw), ("review_info_weight", rw)],
                        "Intent analysis error: ")).alias("error"))


def enhancement(state: DataFrame, outputs: DataFrame | None = None, attempt: int = 0) -> DataFrame:
    """G4 (attempt 0): sub-queries for both sources and focus aspects; malformed output
    -> no sub-queries and ``error``. G5 (later attempts): refined sub-queries and one more
    iteration; malformed output keeps the old ones and sets ``error``, which ends the
    query after the loop."""
    x = parsed(with_response(state, outputs, "enhancement", attempt), ENHANCEMENT)
    p = F.col("_p")
    ok = p.isNotNull()
    new = ["course_db_query", "review_db_query", "focus_aspects", "enhancement_iteration", "error"]
    keep = [c for c in state.columns if c not in new]
    if attempt == 0:
        return x.select(*keep, p["course_db_query"].alias("course_db_query"), p["review_db_query"].alias("review_db_query"),
                        p["focus_aspects"].alias("focus_aspects"), F.lit(0).alias("enhancement_iteration"),
                        F.when(~ok, F.lit(MSG_ENHANCEMENT_PARSE)).alias("error"))
    old = {c: F.col(c) if c in state.columns else F.lit(None) for c in new}
    return x.select(*keep, *[F.when(ok, p[c]).otherwise(old[c]).alias(c) for c in new[:3]],
                    (F.coalesce(old["enhancement_iteration"], F.lit(0)) + ok.cast("int")).alias("enhancement_iteration"),
                    F.when(~ok, F.lit("Query enhancement feedback error: malformed output")).otherwise(old["error"].cast("string")).alias("error"))


def strategy(state: DataFrame, outputs: DataFrame, attempt: int = 0, cap: int | None = None) -> DataFrame:
    """Per-query k for each source; any failure -> 5/5 balanced.
    G8: with ``cap`` (adjusted retrieval), each k is limited to the cap."""
    x = parsed(with_response(state, outputs, "strategy", attempt), STRATEGY)
    p = F.col("_p")
    ok = p["course_k"].isNotNull() & p["review_k"].isNotNull()
    keep = [c for c in state.columns if c not in ("course_k", "review_k", "strategy_reasoning")]
    ck = F.when(ok, p["course_k"]).otherwise(F.lit(DEFAULT_COURSE_K))
    rk = F.when(ok, p["review_k"]).otherwise(F.lit(DEFAULT_REVIEW_K))
    if cap is not None:
        ck, rk = F.least(ck, F.lit(cap)), F.least(rk, F.lit(cap))
    return x.select(*keep, ck.alias("course_k"), rk.alias("review_k"),
                    F.when(ok, p["reasoning"]).otherwise(F.lit(MSG_STRATEGY_DEFAULT)).alias("strategy_reasoning"))


def context_verdict(state: DataFrame, outputs: DataFrame, attempt: int,
                    max_iterations: int = CONTEXT_MAX_ITERATIONS) -> DataFrame:
    """No retrieved info -> pass through (NULL verdict); iteration >= bound ->
    forced sufficient; malformed -> sufficient; needs_improvement = NOT sufficient
    AND NOT unanswerable."""
    x = parsed(with_response(state, outputs, "context", attempt), CONTEXT)
    p = F.col("_p")
    has_info = F.col("n_retrieved") > 0
    forced = F.lit(attempt) >= F.lit(max_iterations)
    bad = p.isNull()
    suff = F.when(forced | bad, F.lit(True)).otherwise(F.coalesce(p["is_sufficient"], F.lit(False)))
    unans = F.when(forced | bad, F.lit(False)).otherwise(F.coalesce(p["unanswerable"], F.lit(False)))
    note = F.when(forced, F.lit(MSG_CONTEXT_MAX)).when(bad, F.lit(MSG_CONTEXT_PARSE))
    keep = [c for c in state.columns if c not in ("is_sufficient", "unanswerable", "needs_improvement",
                                                   "context_note", "improvement_feedback")]
    return x.select(*keep,
                    F.when(has_info, suff).alias("is_sufficient"),
                    F.when(has_info, unans).alias("unanswerable"),
                    F.when(has_info, ~suff & ~unans).otherwise(F.lit(False)).alias("needs_improvement"),
                    F.when(has_info, note).alias("context_note"),
                    F.when(has_info & ~forced, p["feedback"]).alias("improvement_feedback"))


ROUND_COLUMNS = ("n_retrieved", "course_info", "review_info", "is_sufficient", "unanswerable", "needs_improvement",
                 "context_note", "improvement_feedback", "attempts")


def retry_loop(state: DataFrame, outputs: DataFrame | None, retrieve, max_attempts: int = MAX_ATTEMPTS,
               max_iterations: int = CONTEXT_MAX_ITERATIONS) -> DataFrame:
    """At most ``max_attempts`` rounds of (strategy -> retrieve -> context
    verdict -> refined queries); a query leaves the loop when unanswerable, sufficient,
    or at the last attempt. Each round only processes still-open queries and is
    written to the shared folder, so lineage stays short and a lost executor
    recomputes one round; with attached outputs a round has no join of its own.

    ``retrieve(open_state)`` adds ``course_info``, ``review_info`` and ``n_retrieved``
    (G7: each source with the query's own k)."""
    open_q = state if OUTPUTS in state.columns else attach_outputs(state, outputs)
    done = []
    for attempt in range(max_attempts):
        if attempt > 0 and "course_db_query" in open_q.columns:
            open_q = enhancement(open_q, None, attempt)  # G5: feedback refinement
        s = retrieve(strategy(open_q, None, attempt))
        v = context_verdict(s, None, attempt, max_iterations).withColumn("attempts", F.lit(attempt + 1))
        stop = F.coalesce(F.col("unanswerable"), F.lit(False)) | ~F.col("needs_improvement") | \
            F.lit(attempt >= max_attempts - 1)
        v = materialize(v.withColumn("_stop", stop), "retry-round")
        done.append(v.where("_stop").drop("_stop"))
        open_q = v.where(~F.col("_stop")).drop("_stop", *ROUND_COLUMNS)
        if open_q.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def retriever(course_hits: DataFrame, review_hits: DataFrame):
    """``retrieve`` for the loop over hit lists ``(query, doc_id, rank)`` of the distinct
    sub-queries: few texts serve many queries, so each text is searched once, and a
    query takes the first k of its two lists."""
    def lists(hits: DataFrame, name: str) -> DataFrame:
        # bounded: a list has as many entries as the search's k
        return hits.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))),
                                                     lambda x: x["doc_id"]).alias(name))
    sides = {"course": materialize(lists(course_hits, "_course"), "course-lists"),
             "review": materialize(lists(review_hits, "_review"), "review-lists")}

    def retrieve(state: DataFrame) -> DataFrame:
        x = state
        for name, side in sides.items():
            x = x.join(side.withColumnRenamed("query", "_text"), F.col(f"{name}_db_query") == F.col("_text"), "left").drop("_text")
            found = F.coalesce(F.col(f"_{name}"), F.array().cast(side.schema[f"_{name}"].dataType))
            x = x.withColumn(f"{name}_info", F.slice(found, F.lit(1), F.greatest(F.col(f"{name}_k"), F.lit(0)))).drop(f"_{name}")
        return x.withColumn("n_retrieved", F.size("course_info") + F.size("review_info"))
    return retrieve


def response(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """Body, optional 'Note: a, b', optional suggestion bullets; missing inputs ->
    fixed apology; malformed output or a missing key -> its own apology and error."""
    x = parsed(with_response(state, outputs, "response", 0), RESPONSE)
    p = F.col("_p")
    missing = ~(F.coalesce(F.col("n_retrieved"), F.lit(0)) > 0) | F.col("is_sufficient").isNull()
    bad = ~F.col("_json")
    lacking = missing_key("response", [("response", p["response"])], "Response generation error: ")
    notes = F.when(F.coalesce(p["has_limitations"], F.lit(False)),
                   F.concat(F.lit("\n\nNote: "), F.array_join(F.coalesce(p["limitation_notes"],
                                                                        F.array().cast(ARR)), ", ")))
    sugg = F.coalesce(p["additional_suggestions"], F.array().cast(ARR))
    sug_text = F.when(F.size(sugg) > 0, F.concat(F.lit("\n\nAdditional suggestions:\n- "),
                                                 F.array_join(sugg, "\n- ")))
    body = F.concat(p["response"], F.coalesce(notes, F.lit("")), F.coalesce(sug_text, F.lit("")))
    return x.select(*[c for c in state.columns if c != "response"],
                    F.when(missing, F.lit(MSG_RESPONSE_MISSING)).when(bad, F.lit(MSG_RESPONSE_PARSE))
                    .when(lacking.isNotNull(), F.lit(MSG_RESPONSE_ERROR)).otherwise(body).alias("final_response"),
                    F.when(missing, F.lit(None).cast(S)).when(bad, F.lit(MSG_RESPONSE_PARSE_ERROR)).otherwise(lacking)
                    .alias("response_error"))


def error_response(error_col) -> Column:
    """Standard apology for an error message."""
    e = _c(error_col)
    return F.concat(F.lit("I apologize, but I encountered an error: "), e,
                    F.lit(". Please try rephrasing your question."))


def failed(state: DataFrame, message, stage: str) -> DataFrame:
    """The query ends with the standard error response and a history entry."""
    m = message if isinstance(message, Column) else F.lit(message)
    history = F.col("processing_history") if "processing_history" in state.columns else F.lit(None).cast(ARR)
    return state.select("query_id", error_response(m).alias("final_response"), F.lit(stage).alias("stage"),
                        append_history(history, F.concat(F.lit("Error: "), m)).alias("processing_history"))


def append_history(history, entry) -> Column:
    """Processing history log."""
    return F.array_append(F.coalesce(_c(history), F.array().cast(ARR)), _c(entry))


def as_json(c) -> Column:
    """A struct, map or array as indented JSON ('' for NULL)."""
    return F.coalesce(F.to_json(_c(c), {"pretty": "true"}), F.lit(""))


def render_prompt(template: str, **cols) -> Column:
    """Fill ``{name}`` slots of a stage prompt from columns; NULL fills as an empty
    text. Structs and arrays go in as ``as_json`` columns."""
    import re
    parts = []
    tokens = re.split(r"(\{\w+\})", template)
    for t in tokens:
        m = re.fullmatch(r"\{(\w+)\}", t)
        if m and m.group(1) in cols:
            c = cols[m.group(1)]
            parts.append(F.coalesce(_c(c).cast("string"), F.lit("")))
        elif t:
            parts.append(F.lit(t))
    return F.concat(*parts)
