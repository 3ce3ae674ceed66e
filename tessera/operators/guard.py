"""Rule-based input/output guards and the two-level gate.

Every scanner is a Column expression returning ``struct(is_valid, risk_score,
comment)``; the verdict runs all scanners (no short circuit) and lists the
failing ones in scanner order. The needle and rule lists are bounded
configuration compiled into literal arrays / regex alternatives, so a scan is
a projection (no join, no shuffle). Model-based scanners plug in as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import (BANNED_SUBSTRINGS, GATE_NOT_RELEVANT, GATE_POLICY, GATE_VALID,
                            GATE_VALID_MESSAGE, GIBBERISH_THRESHOLD, INJECTION_RULES,
                            INJECTION_THRESHOLD, REFUSAL_PATTERNS, RELEVANT, TOKEN_LIMIT)
from tessera.functions.text import tokens

WORD = r"[\p{L}\p{N}_]"
VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýÿ"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once for all its uses (a lambda's variable is not inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def result(is_valid: Column, risk: Column, comment: Column) -> Column:
    return F.struct(is_valid.alias("is_valid"), risk.cast("double").alias("risk_score"),
                    comment.cast("string").alias("comment"))


def ban_substrings(text, needles=BANNED_SUBSTRINGS, mode: str = "substring") -> Column:
    """V1: case-insensitive; ``substring`` hits inside words, ``word`` does not."""
    t = F.lower(_c(text))
    if mode == "substring":
        hit = lambda low, n: F.instr(low, n) > 0
    elif mode == "word":
        hit = lambda low, n: F.regexp_like(low, F.concat(F.lit("(^|[^\\p{L}\\p{N}_])"), n,
                                                         F.lit("($|[^\\p{L}\\p{N}_])")))
    else:
        raise ValueError(mode)
    listed = F.array(*[F.lit(n.lower()) for n in needles])
    hits = bound(t, lambda low: F.filter(listed, lambda n: hit(low, n)))
    found = lambda h: F.size(h) > 0
    return bound(hits, lambda h: result(~found(h), F.when(found(h), 1.0).otherwise(0.0), F.array_join(h, ", ")))


def token_limit(text, limit: int = TOKEN_LIMIT) -> Column:
    """V4: the text has at most ``limit`` tokens."""
    return bound(F.size(tokens(text)), lambda n: result(n <= limit, F.when(n > limit, 1.0).otherwise(0.0), n.cast("string")))


def gibberish_score(text) -> Column:
    """V2 heuristic in [0, 1]: the larger of (share of 4+-letter words without a
    vowel) and (twice the share of symbol characters); 1 for text without tokens."""
    t = _c(text)
    sym = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))

    def of_words(toks, words):
        novowel = F.size(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike(f"[{VOWELS}]")))
        score = F.least(F.lit(1.0), F.greatest(novowel / F.greatest(F.size(words), F.lit(1)),
                                               F.lit(2.0) * sym / F.greatest(F.length(t), F.lit(1))))
        return F.when(F.size(toks) == 0, F.lit(1.0)).otherwise(F.round(score, 6))

    return bound(tokens(t), lambda toks: bound(F.filter(toks, lambda w: w.rlike(r"^\p{L}+$")), lambda words: of_words(toks, words)))


def gibberish(text, threshold: float = GIBBERISH_THRESHOLD) -> Column:
    return bound(gibberish_score(text), lambda s: result(s < threshold, s, F.lit("")))


def injection(text, rules=INJECTION_RULES, threshold: float = INJECTION_THRESHOLD) -> Column:
    """V3: score = largest weight of a matching rule."""
    t = _c(text)
    weights = [F.when(t.rlike("(?i)" + p), F.lit(float(w))).otherwise(F.lit(0.0)) for p, w in rules]
    s = F.greatest(*weights) if len(weights) > 1 else weights[0]
    return bound(s, lambda s: result(s < threshold, s, F.lit("")))


def no_refusal(text, patterns=REFUSAL_PATTERNS) -> Column:
    """V6: output must not be a refusal."""
    t = _c(text)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | t.rlike("(?i)" + p)
    return result(~hit, F.when(hit, 1.0).otherwise(0.0), F.lit(""))


def always_valid() -> Column:
    """Placeholder for a model-based scanner not supplied (bias)."""
    return result(F.lit(True), F.lit(0.0), F.lit(""))


def closed(text, scanners: list[tuple[str, Column]]) -> list[tuple[str, Column]]:
    """Fail closed: a text that can't be scanned (NULL) fails every scanner."""
    t = _c(text)
    return [(n, F.when(t.isNull(), result(F.lit(False), F.lit(1.0), F.lit("no text"))).otherwise(r)) for n, r in scanners]


def input_scanners(text, banned=BANNED_SUBSTRINGS) -> list[tuple[str, Column]]:
    return closed(text, [("Gibberish", gibberish(text)), ("BanSubstrings", ban_substrings(text, banned)),
                         ("PromptInjection", injection(text)), ("TokenLimit", token_limit(text))])


def output_scanners(text, bias: Column | None = None) -> list[tuple[str, Column]]:
    return closed(text, [("Bias", bias if bias is not None else always_valid()),
                         ("NoRefusal", no_refusal(text)), ("Gibberish", gibberish(text))])


def verdict(df: DataFrame, scanners: list[tuple[str, Column]], prefix: str = "guard") -> DataFrame:
    """A5/V5: all scanners run; valid = all valid; reason lists failing scanner
    names in scanner order; per-scanner results kept as an array of structs."""
    arr = F.array(*[F.struct(F.lit(n).alias("scanner"), r.alias("r")) for n, r in scanners])
    ok = lambda s: F.coalesce(s["r"]["is_valid"], F.lit(False))  # noqa: E731  no answer counts as failed
    x = df.withColumn(f"{prefix}_results", arr)
    res = F.col(f"{prefix}_results")
    failed = F.transform(F.filter(res, lambda s: ~ok(s)), lambda s: s["scanner"])
    x = x.withColumn(f"{prefix}_valid", F.forall(res, ok))
    return x.withColumn(f"{prefix}_reason",
                        F.when(F.col(f"{prefix}_valid"), F.lit(""))
                        .otherwise(F.concat(F.lit("Failed scanners: "), F.array_join(failed, ", "))))


def is_relevant(response) -> Column:
    """the relevance model answered exactly RELEVANT (case-insensitive, no trim)."""
    return F.coalesce(F.upper(_c(response)) == RELEVANT, F.lit(False))


def gate(df: DataFrame, text_col: str, relevance_col: str) -> DataFrame:
    """V8: guard, then relevance; the first failing level decides."""
    g = verdict(df, input_scanners(F.col(text_col)))
    rel = is_relevant(relevance_col)
    return g.withColumn("gate", F.when(~F.col("guard_valid"), F.lit(GATE_POLICY))
                        .when(~rel, F.lit(GATE_NOT_RELEVANT)).otherwise(F.lit(GATE_VALID))) \
        .withColumn("message", F.when(F.col("gate") == GATE_POLICY, F.col("guard_reason"))
                    .when(F.col("gate") == GATE_NOT_RELEVANT, F.lit("Query is not relevant"))
                    .otherwise(F.lit(GATE_VALID_MESSAGE)))


def explanation_prompt(kind: str, query, reason=None) -> Column:
    """V9: prompt asking a model for the three-line explanation."""
    q = _c(query)
    if kind == "guard":
        return F.concat(F.lit("The query was blocked by the content guard. Reason: "),
                        F.coalesce(_c(reason), F.lit("")),
                        F.lit("\nRespond in exactly three lines: status, explanation, suggestion.\nQuery: "), q)
    return F.concat(F.lit("The query is not about courses, professors or reviews."
                          "\nRespond in exactly three lines: status, explanation, suggestion.\nQuery: "), q)


def parse_explanation(response) -> Column:
    """V9 parser: three lines -> struct(status, explanation, suggestion)."""
    ls = F.split(_c(response), "\n")
    return F.struct(F.get(ls, 0).alias("status"), F.get(ls, 1).alias("explanation"),
                    F.get(ls, 2).alias("suggestion"))
