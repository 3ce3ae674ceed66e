"""The incremental index against a full refit after every step."""

import random

from tessera.operators import lexical
from tessera.operators.segments import SegmentedIndex
from tessera.session import work_path


def table(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id bigint, text string")


def found(index, queries):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in lexical.search(index, queries, 5).collect())


def test_steps_equal_a_refit(spark):
    rng = random.Random(2)
    words = "river house light morning letter book walk seven wonder".split()
    text = lambda: " ".join(rng.choices(words, k=rng.randint(2, 15)))
    queries = spark.createDataFrame([(i, text()) for i in range(6)], "query_id bigint, query string")
    index = SegmentedIndex(spark, work_path(spark, "segments"))
    docs = {i: text() for i in range(20)}
    index.add(table(spark, docs))
    more = {i: text() for i in range(15, 30)}  # five of them are new versions
    docs |= more
    index.add(table(spark, more))
    assert found(index.index(), queries) == found(lexical.fit_tfidf(table(spark, docs)), queries)
    index.delete(spark.createDataFrame([(i,) for i in (3, 16, 29, 500)], "doc_id bigint"))
    docs = {i: t for i, t in docs.items() if i not in (3, 16, 29)}
    index.add(spark.createDataFrame([(3, docs[5]), (100, None), (None, "river")], "doc_id bigint, text string"))  # 3 comes back
    docs[3] = docs[5]
    want = lexical.fit_tfidf(table(spark, docs))
    assert found(index.index(), queries) == found(want, queries)
    assert {r.term: r.df for r in index.index().vocab.collect()} == {r.term: r.df for r in want.vocab.collect()}
    # a step without its log entry doesn't count; the next one takes its place
    index._write(table(spark, {7: "x"}).selectExpr("doc_id", "text AS term", "1L AS tf"), "postings", index._next())
    assert found(index.index(), queries) == found(want, queries)
    packed = index.compact(work_path(spark, "segments"))
    assert found(packed.index(), queries) == found(want, queries)


def test_an_empty_index(spark):
    index = SegmentedIndex(spark, work_path(spark, "segments"))
    queries = spark.createDataFrame([(1, "river")], "query_id bigint, query string")
    index.add(spark.createDataFrame([], "doc_id bigint, text string"))
    assert found(index.index(), queries) == []
    index.add(spark.createDataFrame([(1, "river")], "doc_id bigint, text string"))
    index.delete(spark.createDataFrame([(1,)], "doc_id bigint"))
    assert found(index.index(), queries) == []
