"""The registered gates scan every real text; rows without one fail closed."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.config import GATE_POLICY
from tessera.operators import guard as G

CONVERSATIONS = "conv_id bigint, turn int, role string, text string"
CLEAN = "What should we read about the history of rivers this week?"


def texts(n=46):
    return [(i, CLEAN) for i in range(n)] + [(1_000, None), (1_001, "")]


def test_input_verdict_scans_every_text(spark, tmp_path):
    rows = [(i, 0, "user", t) for i, t in texts()]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in E.queries()["input_verdict"](spark, str(tmp_path)).collect()}
    assert all(got[i].is_valid and got[i].reason == "" for i in range(46))
    assert not got[1_000].is_valid and not got[1_001].is_valid


def test_two_level_gate_scans_every_text(spark, tmp_path):
    spark.createDataFrame(texts(), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, _ in texts()], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.gate for r in E.queries()["two_level_gate"](spark, str(tmp_path)).collect()}
    assert {i for i, gate in got.items() if gate == GATE_POLICY} == {1_000, 1_001}


def test_missing_and_empty_texts_fail_closed(spark):
    df = spark.createDataFrame([(None,), ("",), (CLEAN,)], "t string")
    v = G.verdict(df, G.input_scanners(F.col("t"))).collect()
    assert [r.guard_valid for r in v] == [False, False, True]
