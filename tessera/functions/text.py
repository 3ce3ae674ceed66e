"""Column functions for text: tokens, n-grams, whitespace. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import TOKEN_PATTERN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, pattern: str = TOKEN_PATTERN) -> Column:
    """Lowercase, then all matches of the token pattern."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), 0)


def bigrams(toks) -> Column:
    """Adjacent token pairs joined by one blank (R2)."""
    t = _col(toks)
    return F.when(
        F.size(t) >= 2,
        F.transform(F.sequence(F.lit(0), F.size(t) - 2),
                    lambda i: F.concat(t[i], F.lit(" "), t[i + 1])),
    ).otherwise(F.array().cast("array<string>"))


def grams_of_tokens(toks, ngram_max: int = 2) -> Column:
    """1-grams followed by 2-grams of a token array column (ngram_range=(1, 2))."""
    t = _col(toks)
    return t if ngram_max == 1 else F.concat(t, bigrams(t))


def with_grams(df, id_cols, text_col: str, out: str = "g", ngram_max: int = 2,
               pattern: str = TOKEN_PATTERN):
    """Project ``id_cols`` + gram array ``out``.

    Tokens are computed in their own projection: the bigram lambda reads the
    token array several times, and the optimizer keeps an expensive projection
    separate when it is referenced more than once, so the regex runs once per row."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return (df.select(*ids, tokens(text_col, pattern).alias("_t"))
            .select(*ids, grams_of_tokens("_t", ngram_max).alias(out)))


def explode_nonempty(arr, name: str) -> Column:
    """``explode_outer`` + a later ``IS NOT NULL`` filter instead of ``explode``.

    A plain explode makes the optimizer infer ``size(arr) > 0`` and push it
    below the projections, inlining (and re-running) the whole array
    expression; the outer form infers nothing."""
    return F.explode_outer(_col(arr)).alias(name)


def collapse_ws(text) -> Column:
    """Split on any whitespace and join by one blank: " ".join(x.split())."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def words(text) -> Column:
    """Whitespace tokens of the lowercased text (str.lower().split())."""
    c = F.trim(F.regexp_replace(F.lower(_col(text)), r"\s+", " "))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
