"""Tokens matched inside the tasks are those of the pattern in Spark, on every character."""

from __future__ import annotations

from tessera.functions.text import tokens
from tessera.operators import lexical


def test_tokens_are_those_of_the_pattern(spark):
    texts = ["", None, "A b_c 12 x-y", "=== Course_1 === rest ===\x85x===", "===\x1cx=== === y=== ===\t z\n===", "a’b €5 ²½ªºµ",
             "İstanbul ẞ ΣΣ ÄÖ", "中文 Ж x", "é K Ω", "\U0001d7d8 \U0001f600 a"]
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}b {chr(c)} " for c in codes[i:i + 4096]) for i in range(0, len(codes), 4096)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.t for r in docs.select("doc_id", tokens("text").alias("t")).collect()}
    patterns = lexical.token_patterns(spark)
    rows = lexical.text_rows(docs, "doc_id", "text").mapInArrow(lambda batches: lexical.tokenized(batches, patterns), "_id long, _t array<string>")
    got = {r._id: r._t for r in rows.collect()}
    assert got == {i: t or [] for i, t in want.items()}


def test_few_rows_of_a_text_cross_from_spark(spark):
    """The tasks get texts, not a string per token; a slice comes out as at most a row a block."""
    docs = spark.createDataFrame([(i, f"w{i} common " * 50) for i in range(40)], "doc_id long, text string")
    index = lexical.fit_tfidf(docs)
    assert dict(lexical.text_rows(docs, "doc_id", "text").dtypes) == {"doc_id": "bigint", "_t": "string"}
    per_slice = index.blocks.groupBy("slice").count().agg({"count": "max"}).first()[0]
    assert per_slice <= 1 << lexical.BLOCK_BITS
    found = {r.term: (r.df, r.cf) for r in index.vocab.collect()}
    assert found["common"] == (40, 2000) and found["w3 common"] == (1, 50) and len(found) == 1 + 3 * 40
