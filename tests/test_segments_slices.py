"""Segments are slices: no row per posting is written, and only slices with a document that is gone are counted again."""

import random

from tessera.operators import lexical
from tessera.operators.segments import SegmentedIndex
from tessera.session import work_path


def test_segments_hold_slices_and_the_live_ones_equal_a_fit(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices("river house light morning letter book".split(), k=rng.randint(0, 60)))
    docs = {i: text() for i in range(300)}
    table = lambda own: spark.createDataFrame(sorted(own.items()), "doc_id bigint, text string")
    index = SegmentedIndex(spark, work_path(spark, "segments"))
    index.add(table(docs))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 40)], "doc_id bigint"))
    docs = {i: t for i, t in docs.items() if i >= 40}
    new = {i: text() for i in (3, 50, 299, 1_000)}
    docs |= new
    index.add(table(new))
    stored = spark.read.parquet(f"{index.path}/slices")
    assert stored.count() <= stored.select("step", "slice").distinct().count() << lexical.BLOCK_BITS
    # a step without its log entry doesn't count
    index._write(lexical.slice_rows(lexical.text_rows(table({7: "river"}), "doc_id", "text"), 2, lexical.token_patterns(spark)), "slices", index._next())
    for own in (index, index.compact(work_path(spark, "segments"))):
        got, want = own.index(persist=False), lexical.fit_tfidf(table(docs))
        assert {tuple(r) for r in got.vocab.collect()} == {tuple(r) for r in want.vocab.collect()}
        weights = lambda x: {(r.doc_id, r.term, r.tf): round(r.w, 12) for r in x.postings.collect()}
        assert weights(got) == weights(want)
    index.add(table(docs))  # every document anew: no earlier slice is read
    live = index.live().select("slice").distinct().collect()
    assert live and {r.slice >> 50 for r in live} == {3}
