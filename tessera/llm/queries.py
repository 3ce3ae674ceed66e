"""Registered queries of the training-data operators: thin wrappers that apply
an operator with production parameters to its whole table and derive the
columns of the query's contract from the operator's real output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_templates, language_id, minhash_dedup, mixing, nra_search, phrases, secrets, sentencepiece_fst, skip_chain, token_counts, token_output, topk_search
from .common import fresh_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the cache folder is new for each call."""
    tok = token_counts.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tok, fresh_path(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written with a shared dictionary and read back."""
    path = fresh_path(spark, "token-ids")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path,
                              token_output.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    return token_output.read_digests(spark, path)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source."""
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op3_mixing"] = mixing.oracle_sql()


@query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every 50th vector among all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op4_topk_search"] = topk_search.oracle_sql()


@query
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS[:3]],
                        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text by the compiled transducer, and whether they decode to the text."""
    fst = sentencepiece_fst.compile_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"), fst, with_ids=False)


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_templates.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document at edit similarity 0.8, and the one document kept of it."""
    found = minhash_dedup.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return nra_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_ranked_search"] = nra_search.oracle_sql()


@query
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_phrase_mining"] = phrases.oracle_sql()


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    found = skip_chain.scan(docs, skip_chain.fit(docs))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(skip_chain.KINDS))
    return found.select("doc_id", *[count(k) for k in skip_chain.KINDS], F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
                        secrets.span_list(F.col("spans")).alias("spans"))
