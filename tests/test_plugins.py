"""Plug-in models: loaded once per worker, batches, nulls, and use as a scorer."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import guard, plugins, rerank


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()  # a mark for each load
        return lambda texts: [len(t) for t in texts]

    score = plugins.text_scorer("lengths", factory)
    df = spark.range(2_000).repartition(16).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("t"), "id")).alias("t"))
    got = df.select("t", score("t").alias("s")).collect()
    assert all((r.s is None) if r.t is None else r.s == len(r.t) for r in got)
    pids = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(pids) == len(set(pids)) <= 16


def test_pair_scorer_reranks_and_a_scorer_guards(spark):
    pair = plugins.pair_scorer("common", lambda: lambda q, d: [len(set(a.split()) & set(b.split())) for a, b in zip(q, d, strict=True)])
    rows = [(1, "river house", 1, "a house by the river", 2), (1, "river house", 2, "a letter", 1), (1, "river house", 3, None, 3)]
    cands = spark.createDataFrame(rows, "query_id int, query string, doc_id int, text string, rank int")
    got = rerank.rerank(cands, 3, scorer=pair).orderBy("rank").collect()
    assert [(r.doc_id, r.rerank_score) for r in got] == [(1, 2.0), (2, 0.0), (3, None)]
    rude = plugins.text_scorer("rude", lambda: lambda texts: [float("hate" in t) for t in texts])
    scanner = guard.result(rude(F.col("t")) < 0.5, rude(F.col("t")), F.lit(""))
    v = guard.verdict(spark.createDataFrame([("we hate it",), ("fine",)], "t string"), [("Rude", scanner)])
    assert {r.t: r.guard_valid for r in v.collect()} == {"we hate it": False, "fine": True}


def test_embedder_generator_and_wrong_counts(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    embed = plugins.embedder("two", lambda: lambda texts: [[len(t), 1.0] for t in texts])
    assert [r.v for r in df.select(embed("t").alias("v")).collect()] == [[2.0, 1.0], None, [0.0, 1.0]]
    say = plugins.generator("say", lambda: lambda texts: [t.upper() + "!" for t in texts])
    assert [r.v for r in df.select(say("t").alias("v")).collect()] == ["AB!", None, "!"]
    bad = plugins.text_scorer("bad", lambda: lambda texts: [])
    with pytest.raises(Exception, match="returned 0 results"):
        df.select(bad("t")).collect()
