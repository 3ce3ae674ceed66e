"""Token counts through a digest cache.

A count is stored under two digests: that of the normalised content (a null
text counts as empty; the tokenizer's own normaliser runs inside its encoder)
and that of the tokenizer version (library, library version, file bytes). A
call joins the documents' digests to the cache, encodes each distinct missing
content once, appends the new counts to the cache, and answers from it.

Defined results: null texts count 0 tokens and 0 bytes; copies are encoded
once and all get the count; repeated rows are all returned; an empty table
gives an empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_bytes, slices, stored, whole_text
from .token_output import task_encoder

CACHE_SCHEMA = "content binary, n_tokens bigint, tokenizer string"


class Tokenizer:
    """A tokenizer file and the library that reads it (by its suffix): what is
    shipped to the tasks, and the digest that names this version."""

    def __init__(self, path: str):
        self.kind = "sentencepiece" if os.fspath(path).endswith(".model") else "tokenizers"
        self.data = file_bytes(path)
        if self.kind == "sentencepiece":
            import sentencepiece as lib
        else:
            import tokenizers as lib
        version = f"{self.kind} {lib.__version__} no-special-tokens"
        self.digest = hashlib.sha256(version.encode() + b"\0" + self.data).hexdigest()

    def counter(self):
        """texts -> number of ids of each, no special tokens added, nothing cut."""
        if self.kind == "sentencepiece":
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=self.data)

            def count(texts):
                return [len(x) for x in sp.encode(texts, out_type=int, add_bos=False, add_eos=False, num_threads=1)]
        else:
            enc = task_encoder(self.data)

            def count(texts):
                return [len(x) for x in enc.encode(texts)]
        return count


def content_digest(column: str) -> F.Column:
    return F.unhex(F.sha2(F.col(column), 256))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; parallel writers may have stored one twice."""
    kept = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer)
    return kept.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def open_cache(spark: SparkSession, path: str) -> None:
    """Make an empty cache, if there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(path)


def count_tokens(documents: DataFrame, tokenizer: Tokenizer, cache: str, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``cache`` is a folder that grows.

    Texts are shuffled once, and only those of one row per missing content stay."""
    spark = documents.sparkSession
    texts = documents.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    texts = texts.withColumn("content", content_digest("text"))
    keys = stored(texts.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes")), "token-keys")
    open_cache(spark, cache)
    # one row per content; copies meet as partial sums, so a hot content is one row per task
    needed = stored(keys.groupBy("content").agg(F.min("doc_id").alias("doc_id")), "token-contents")
    misses = needed.join(read_cache(spark, cache, tokenizer.digest), "content", "left_anti")
    # the id keeps copies of a hot content in different partitions here
    todo = texts.join(misses, (texts["content"] == misses["content"]) & texts["doc_id"].eqNullSafe(misses["doc_id"]),
                      "left_semi")

    def encode(batches):
        count = tokenizer.counter()
        for batch in batches:
            some = batch.column("text").to_pylist()
            n = [c for a, b in slices(some) for c in count(some[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(np.asarray(n, np.int64))],
                                             ["content", "n_tokens"])

    # rows that repeat an id and its content come as one count
    (todo.select("content", "text").mapInArrow(encode, "content binary, n_tokens bigint").dropDuplicates(["content"])
     .withColumn("tokenizer", F.lit(tokenizer.digest)).write.mode("append").partitionBy("tokenizer").parquet(cache))
    # stored, so that a hot content's side of the last join is a plain shuffle, which Spark can split
    counts = stored(read_cache(spark, cache, tokenizer.digest).join(needed.select("content"), "content"), "token-counts")
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")


