"""Needle tables against plain searches."""

import random
import re

import pytest

from tessera.operators import needles


def corpus(seed):
    rng = random.Random(seed)
    parts = ["ab", "a", "b", "abc", "Été", "x_1", " ", ".", "日本", "bca", "C"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "ab" * 20_000), (0, "ab again")]
    table = [("a",), ("ab",), ("ABC",), ("bcab",), ("été",), ("x_1",), ("日",), ("",), (None,), ("zzz",), ("ab",), ("b.a",)]
    return texts, table


@pytest.mark.parametrize("mode", needles.MODES)
@pytest.mark.parametrize("block", [200_000, 3])
def test_hits_equal_plain_search(spark, mode, block, monkeypatch):
    monkeypatch.setattr(needles, "BLOCK", block)
    texts, table = corpus(1)
    want = set()
    for i, t in texts:
        for n in {x.lower() for x, in table if x}:
            low = (t or "").lower()
            if n in low if mode == "substring" else re.search(rf"(?<!\w){re.escape(n)}(?!\w)", low):
                want.add((i, n))
    got = needles.hits(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(table, "needle string"), "id", mode=mode).collect()
    assert {(r.id, r.needle) for r in got} == want


def test_empty_tables_and_many_needles(spark):
    texts = spark.createDataFrame([(i, f"word{i * 7} and word{i * 11}x") for i in range(300)], "id bigint, text string")
    none = spark.createDataFrame([], "needle string")
    assert needles.hits(texts, none, "id").count() == 0 and needles.hits(texts.limit(0), none, "id").count() == 0
    many = spark.range(100_000).selectExpr("concat('word', id) AS needle")
    got = needles.hits(texts, many, "id", mode="word")
    assert got.count() == 300  # the x is part of the second word


def test_rules_choose_the_least_priority(spark):
    rules = [("course", 2, "art", "art"), ("course", 1, "artful", "artful"), ("term", 1, "spring", "spring 2025"), ("campus", 1, "Boston", "boston")]
    table = spark.createDataFrame(rules, "field string, priority int, needle string, value string")
    queries = spark.createDataFrame([(1, "An ARTFUL spring"), (2, "art in Boston"), (3, "nothing"), (4, None)], "query_id bigint, query string")
    got = {r.query_id: (r.course, r.professor, r.term, r.campus) for r in needles.query_parts(queries, table).collect()}
    assert got == {1: ("artful", None, "spring 2025", None), 2: ("art", None, None, "boston"), 3: (None,) * 4, 4: (None,) * 4}
