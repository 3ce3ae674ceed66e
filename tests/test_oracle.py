"""Registered queries against their DuckDB SQL twins on sf0.001 (a fast subset)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import digest
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["tokenize_counts", "tfidf_topk", "course_text", "course_sentence", "time_format", "query_parts",
        "enhanced_query", "dense_topk_l2", "hash_embed", "report_reviews", "html_text", "html_links",
        "section_days", "input_verdict", "template_expand", "seeded_sample", "batch_number",
        "parse_validation", "retry_loop", "rouge_n", "bleu_corpus", "stream_dedupe", "csv_roundtrip"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, drows)[0]


def test_every_query_registered_with_entry(spark):
    q = E.queries()
    assert len(q) >= 60
    assert set(E.oracle_sql()) <= set(q)
    assert E.entry(spark).count() >= 0
