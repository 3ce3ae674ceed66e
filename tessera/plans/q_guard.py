"""Registered guard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import (BANNED_SUBSTRINGS, GATE_NOT_RELEVANT, GATE_POLICY, GATE_VALID,
                            GATE_VALID_MESSAGE, GIBBERISH_THRESHOLD, INJECTION_RULES,
                            INJECTION_THRESHOLD, REFUSAL_PATTERNS, TOKEN_LIMIT)
from tessera.functions.text import tokens
from tessera.operators import guard as G
from tessera.plans.registry import register
from tessera.plans.sqlfrag import sq, tokens_sql
from tessera.sources.tables import load

NEEDLES_SQL = "[" + ", ".join(sq(n.lower()) for n in BANNED_SUBSTRINGS) + "]"


def ban_hits_sql(t: str) -> str:
    return f"list_filter({NEEDLES_SQL}, lambda n: instr(lower({t}), n) > 0)"


def gib_sql(t: str) -> str:
    toks = tokens_sql(t)
    words = f"list_filter({toks}, lambda w: regexp_full_match(w, '\\p{{L}}+'))"
    novowel = (f"len(list_filter({words}, lambda w: length(w) >= 4 AND NOT "
               f"regexp_matches(w, '[{G.VOWELS}]')))")
    sym = f"length(regexp_replace({t}, '[\\p{{L}}\\p{{N}}\\s]', '', 'g'))"
    return (f"(CASE WHEN len({toks}) = 0 THEN 1.0 ELSE round(least(1.0, greatest({novowel} / "
            f"greatest(len({words}), 1), 2.0 * {sym} / greatest(length({t}), 1))), 6) END)")


def inj_sql(t: str) -> str:
    parts = [f"(CASE WHEN regexp_matches({t}, {sq('(?i)' + p)}) THEN CAST({float(w)} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
             for p, w in INJECTION_RULES]
    return f"greatest({', '.join(parts)})"


def refusal_sql(t: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {sq('(?i)' + p)})" for p in REFUSAL_PATTERNS) + ")"


def ntok_sql(t: str) -> str:
    return f"len({tokens_sql(t)})"


def input_flags_sql(t: str) -> str:
    def ok(flag, name):  # a text that can't be scanned fails
        return f"({t} IS NOT NULL AND coalesce({flag}, false)) AS {name}"
    return ", ".join([ok(f"{gib_sql(t)} < {GIBBERISH_THRESHOLD}", "g_ok"), ok(f"len({ban_hits_sql(t)}) = 0", "b_ok"),
                      ok(f"{inj_sql(t)} < {INJECTION_THRESHOLD}", "p_ok"), ok(f"{ntok_sql(t)} <= {TOKEN_LIMIT}", "t_ok")])


INPUT_REASON_SQL = ("CASE WHEN g_ok AND b_ok AND p_ok AND t_ok THEN '' ELSE 'Failed scanners: ' || "
                    "concat_ws(', ', CASE WHEN NOT g_ok THEN 'Gibberish' END, CASE WHEN NOT b_ok THEN "
                    "'BanSubstrings' END, CASE WHEN NOT p_ok THEN 'PromptInjection' END, "
                    "CASE WHEN NOT t_ok THEN 'TokenLimit' END) END")


def _user_turns(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where(F.col("role") == "user")


@register("banned_scan", sql=f"""
SELECT conv_id, turn, len({ban_hits_sql('text')}) = 0 AS is_valid,
  array_to_string({ban_hits_sql('text')}, ', ') AS hits FROM conversations WHERE role = 'user'""")
def banned_scan(spark, sf_dir):
    """V1 on user turns (substring mode)."""
    c = _user_turns(spark, sf_dir).select("conv_id", "turn", G.ban_substrings("text").alias("r"))
    return c.select("conv_id", "turn", F.col("r.is_valid").alias("is_valid"), F.col("r.comment").alias("hits"))


# A needle list of this corpus: words that its license lines and secrets hold.
CORPUS_NEEDLES = ["license", "password", "token = ", "akia"]
CORPUS_HITS_SQL = "list_filter([" + ", ".join(sq(n) for n in CORPUS_NEEDLES) + "], lambda n: instr(lower(text), n) > 0)"


@register("banned_scan_docs", sql=f"""
SELECT doc_id, array_to_string({CORPUS_HITS_SQL}, ', ') AS hits FROM documents WHERE len({CORPUS_HITS_SQL}) > 0""")
def banned_scan_docs(spark, sf_dir):
    """V1 over the whole document corpus with a caller's needle list: documents with at least one needle."""
    d = load(spark, sf_dir, "documents").select("doc_id", G.ban_substrings("text", CORPUS_NEEDLES).alias("r"))
    return d.where(~F.col("r.is_valid")).select("doc_id", F.col("r.comment").alias("hits"))


@register("token_limit", sql=f"""
SELECT doc_id, CAST({ntok_sql('text')} AS INTEGER) AS n_tokens, {ntok_sql('text')} <= {TOKEN_LIMIT} AS is_valid
FROM documents WHERE text IS NOT NULL""")
def token_limit_q(spark, sf_dir):
    """V4 on documents."""
    d = load(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    d = d.select("doc_id", F.size(tokens("text")).alias("n_tokens"))
    return d.select("doc_id", F.col("n_tokens").cast("int"), (F.col("n_tokens") <= TOKEN_LIMIT).alias("is_valid"))


@register("gibberish_score", sql=f"""
SELECT conv_id, turn, {gib_sql('text')} AS score FROM conversations WHERE text IS NOT NULL""")
def gibberish_score(spark, sf_dir):
    """V2 heuristic score on every conversation turn."""
    c = load(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return c.select("conv_id", "turn", G.gibberish_score("text").alias("score"))


@register("injection_scan", sql=f"""
SELECT conv_id, turn, {inj_sql('text')} AS score, {inj_sql('text')} < {INJECTION_THRESHOLD} AS is_valid
FROM conversations WHERE role = 'user'""")
def injection_scan(spark, sf_dir):
    """V3 on user turns."""
    c = _user_turns(spark, sf_dir).select("conv_id", "turn", G.injection("text").alias("r"))
    return c.select("conv_id", "turn", F.col("r.risk_score").alias("score"), F.col("r.is_valid").alias("is_valid"))


@register("input_verdict", sql=f"""
WITH f AS (SELECT conv_id, turn, {input_flags_sql('text')} FROM conversations WHERE role = 'user')
SELECT conv_id, turn, g_ok AND b_ok AND p_ok AND t_ok AS is_valid, {INPUT_REASON_SQL} AS reason FROM f""")
def input_verdict(spark, sf_dir):
    """V5: all four input scanners, verdict and failing scanner list."""
    c = _user_turns(spark, sf_dir)
    v = G.verdict(c, G.input_scanners(F.col("text")))
    return v.select("conv_id", "turn", F.col("guard_valid").alias("is_valid"), F.col("guard_reason").alias("reason"))


@register("output_verdict", sql=f"""
WITH f AS (SELECT conv_id, turn, NOT {refusal_sql('text')} AS r_ok, {gib_sql('text')} < {GIBBERISH_THRESHOLD} AS g_ok
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, r_ok AND g_ok AS is_valid,
  CASE WHEN r_ok AND g_ok THEN '' ELSE 'Failed scanners: ' || concat_ws(', ', CASE WHEN NOT r_ok THEN 'NoRefusal' END,
    CASE WHEN NOT g_ok THEN 'Gibberish' END) END AS reason FROM f""")
def output_verdict(spark, sf_dir):
    """V6/V7: output scanners on assistant turns (bias scanner not supplied: valid)."""
    c = load(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    v = G.verdict(c, G.output_scanners(F.col("text")))
    return v.select("conv_id", "turn", F.col("guard_valid").alias("is_valid"), F.col("guard_reason").alias("reason"))


# Relevance model outputs derived from the labels table: quality 1 -> 'relevant'.
RELEVANCE_SQL = "(CASE WHEN quality = 1 THEN 'relevant' WHEN quality = 0 THEN 'NOT RELEVANT' END)"


@register("two_level_gate", sql=f"""
WITH f AS (SELECT d.doc_id, {input_flags_sql('d.text')}, {RELEVANCE_SQL} AS response
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id,
  CASE WHEN NOT (g_ok AND b_ok AND p_ok AND t_ok) THEN {sq(GATE_POLICY)}
       WHEN coalesce(upper(response) = 'RELEVANT', false) THEN {sq(GATE_VALID)} ELSE {sq(GATE_NOT_RELEVANT)} END AS gate,
  CASE WHEN NOT (g_ok AND b_ok AND p_ok AND t_ok) THEN {INPUT_REASON_SQL}
       WHEN coalesce(upper(response) = 'RELEVANT', false) THEN {sq(GATE_VALID_MESSAGE)} ELSE 'Query is not relevant' END AS message
FROM f""")
def two_level_gate(spark, sf_dir):
    """V8 + F7: documents as queries; relevance responses derived from labels."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    lab = load(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "relevant").when(F.col("quality") == 0, "NOT RELEVANT")
        .alias("response"))
    g = G.gate(d.join(lab, "doc_id", "left"), "text", "response")
    return g.select("doc_id", "gate", "message")


@register("guard_eval", sql=f"""
WITH f AS (SELECT l.toxic, {input_flags_sql('d.text')} FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT toxic, NOT (g_ok AND b_ok AND p_ok AND t_ok) AS flagged, count(*) AS n FROM f GROUP BY ALL""")
def guard_eval(spark, sf_dir):
    """Guard verdict against the toxic label: confusion counts."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    v = G.verdict(lab.join(d, "doc_id"), G.input_scanners(F.col("text")))
    return v.groupBy("toxic", (~F.col("guard_valid")).alias("flagged")).agg(F.count(F.lit(1)).alias("n"))

