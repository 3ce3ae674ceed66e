"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

1. language ID: documents without a letter, or whose words have no certain language, go;
2. MinHash near-dedup: one document of each group of copies stays;
3. secret scans: secret values in the texts are replaced by marks;
4. mixing: rows are repeated or left out so that sources meet their targets;
5. SentencePiece: ids of every text, checked by decoding them.

Defined results: null and empty texts go in the first stage (no letter); null ids, langs
and sources are kept as they are (a null source is a source of its own, a null lang never
trains); repeated rows are copies, of which one stays; extra columns, whatever their names,
go along to the fourth stage; without a labelled row the first stage keeps every text with
a letter; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, minhash_dedup, mixing, secrets, sentencepiece_fst
from tessera.llm.common import stored, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a determined language; the model is fitted on ``docs``."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secret values replaced, ``n_chars`` renewed."""
    return secrets.redact_documents(docs, length_column="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix to weights 1, 2, 3 takes them."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 and round_trip of every row."""
    return sentencepiece_fst.encode(docs, sentencepiece_fst.compile_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", identify_languages),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: SQL can't express the fitted model, the sketches and the lexer; tests hold each stage
#: against a plain version of its own (all pairs by edit distance, the base patterns, the
#: targets by water filling, the library).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
