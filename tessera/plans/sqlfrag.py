"""DuckDB SQL fragments shared by the oracle queries (lists are 1-based there)."""

from __future__ import annotations

from tessera.config import TOKEN_PATTERN


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {sq(TOKEN_PATTERN)})"


def bigrams_sql(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def grams_cte(prefix: str, source: str, id_expr: str, text_expr: str) -> str:
    """CTEs ``{prefix}_tok(id, t)`` and ``{prefix}_tf(id, term, tf)``."""
    return f"""{prefix}_tok AS (SELECT {id_expr} AS id, {tokens_sql(text_expr)} AS t
      FROM {source} WHERE {text_expr} IS NOT NULL),
    {prefix}_g AS (SELECT id, unnest(t) AS term FROM {prefix}_tok
      UNION ALL SELECT id, unnest({bigrams_sql('t')}) AS term FROM {prefix}_tok),
    {prefix}_tf AS (SELECT id, term, count(*) AS tf FROM {prefix}_g GROUP BY id, term)"""


def tfidf_ctes(doc_source: str, doc_id: str, doc_text: str,
               q_source: str | None = None, q_id: str | None = None, q_text: str | None = None) -> str:
    """CTEs: d_tf, vocab(term, df, idf), dn(id, norm, n_terms), post(id, term, w)
    and, with a query source, qv(id, term, qw) and scores(qid, doc_id, score)."""
    s = f"""{grams_cte('d', doc_source, doc_id, doc_text)},
    n_docs AS (SELECT count(*) AS n FROM {doc_source} WHERE {doc_text} IS NOT NULL),
    vocab AS (SELECT term, count(*) AS df,
      ln((1 + (SELECT n FROM n_docs)) / (1.0 + count(*))) + 1 AS idf FROM d_tf GROUP BY term),
    dw AS (SELECT id, term, tf, tf * idf AS w FROM d_tf JOIN vocab USING (term)),
    dn AS (SELECT id, sqrt(sum(w * w)) AS norm, count(*) AS n_terms FROM dw GROUP BY id),
    post AS (SELECT id, term, w / norm AS w FROM dw JOIN dn USING (id))"""
    if q_source:
        s += f""",
    {grams_cte('q', q_source, q_id, q_text)},
    qw0 AS (SELECT id, term, tf * idf AS qw FROM q_tf JOIN vocab USING (term)),
    qv AS (SELECT id, term, qw / sqrt(sum(qw * qw) OVER (PARTITION BY id)) AS qw FROM qw0),
    scores AS (SELECT qv.id AS qid, post.id AS doc_id, round(sum(post.w * qv.qw), 6) AS score
      FROM qv JOIN post USING (term) GROUP BY qv.id, post.id)"""
    return s
