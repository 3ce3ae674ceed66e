"""Lexical retrieval: TF-IDF index and top-k search (R1-R4, A1-A3, J3), BM25.

The index is three tables: ``postings(doc_id, term, tf, w)`` with L2-normalised
weights, ``vocab(term, df, idf)`` and ``norms(doc_id, norm, n_terms)``.
Weighting follows the common smooth-idf convention: tf is the raw count,
``idf = ln((1 + N) / (1 + df)) + 1``, each document vector L2-normalised;
query terms outside the vocabulary are dropped.

Plan shape (what to look for in ``explain``):
* slices: texts dealt and sorted by id; a task numbers the tokens of some whole
  documents (a slice) and counts their grams as numbers, so no row per gram is
  built. A slice's terms lie in the order of their hash, cut into BLOCKS rows of
  Arrow streams, which are written once (``slice_blocks``);
* df: only names and local counts are dealt, by ranges of the hash, into groups of
  bounded bytes; a group adds them up, and numbers alone go back (``term_sums``);
* norm: a slice holds whole documents, so its counts and the sums that came back
  give its norms, without a row per posting;
* search: a block finds the queries' terms, whose documents meet the norms of their
  slice, where each query keeps its k best; the (query, doc) pairs are never rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.config import BM25_B, BM25_EPSILON, BM25_K1, TOKEN_PATTERN
from tessera.functions.text import explode_nonempty, tokens, with_grams, words
from tessera.operators.topk import top_k
from tessera.session import DEFAULT_BROADCAST_ROWS, dealt_parts, fits, materialize


DOC_SENTINEL = "\u0000"  # one per document: its document frequency is N


def term_counts(df: DataFrame, id_col: str, text_col: str, ngram_max: int = 2,
                sentinel: bool = False) -> DataFrame:
    """(id, term, tf): raw gram counts per row. Rows are dealt by id before the tokenizer,
    so the counts need no shuffle of the (much larger) gram rows.
    ``sentinel=True`` adds one NUL term per row, so counting rows rides along
    with the document-frequency aggregation instead of a separate job."""
    g = with_grams(df.select(id_col, text_col).repartition(dealt_parts(df.sparkSession), id_col), id_col, text_col, "g", ngram_max)
    if sentinel:
        g = g.select(id_col, F.concat(F.array(F.lit(DOC_SENTINEL)), F.col("g")).alias("g"))
    return (g.select(id_col, explode_nonempty("g", "term")).where(F.col("term").isNotNull())
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


#: Grams of a slice (a task holds one slice at a time), rows of its batches, queries of a search's block.
SLICE_GRAMS, SLICE_BATCH, QUERY_BLOCK = 2_000_000, 50_000, 4096
#: Texts that are matched at a time, and the pattern's class of letters and digits.
TEXT_ROWS, TOKEN_CLASS = 256, r"[\p{L}\p{N}_]"
#: Blocks of a slice, by the first BLOCK_BITS bits of a term's hash, names of a part of the vocabulary, and bytes of names that are
#: added up at once (less if few).
BLOCK_BITS, PACK_ROWS, GROUP_BYTES, SMALL_GROUP = 5, 100_000, 48_000_000, 4_000_000


def sliced(rows: Iterator[pa.RecordBatch], grams_per_token: int) -> Iterator[pa.Table]:
    """Tables (id, tokens) of about SLICE_GRAMS grams each, from rows sorted by id; an id stays in one."""
    pending = None
    for batch in rows:
        new = pa.Table.from_batches([batch])
        pending = new if pending is None else pa.concat_tables([pending, new])
        while pending.num_rows:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(pending.column(1)), 0).to_numpy().astype(np.int64)) * grams_per_token
            if upto[-1] < SLICE_GRAMS:
                break
            ids = pending.column(0).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new_id = np.append(np.flatnonzero(np.diff(ids)) + 1, len(ids))
            end = new_id[np.searchsorted(new_id, np.searchsorted(upto, SLICE_GRAMS) + 1)]
            if end == len(ids):  # the last id may go on in the next batch
                break
            yield pending.slice(0, end)
            pending = pending.slice(end)
    if pending is not None and pending.num_rows:
        yield pending


def counted(table: pa.Table, ngram_max: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, terms, and per (term, id) in that order the numbers of term and id and the count, of one slice."""
    ids = table.column(0).combine_chunks().dictionary_encode("encode")
    lists = table.column(1).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words_ = lists.flatten().dictionary_encode()
    word, vocabulary = words_.indices.to_numpy().astype(np.int64), words_.dictionary
    row = np.repeat(np.arange(len(sizes)), sizes)
    doc, n_docs, n_words = ids.indices.to_numpy().astype(np.int64), max(1, len(ids.dictionary)), max(1, len(vocabulary))
    keys, terms = [word * n_docs + doc[row]], [vocabulary.cast(pa.string())]
    if ngram_max > 1 and len(word) > 1:
        first = np.flatnonzero(row[:-1] == row[1:])
        pairs, pair = np.unique(word[first] * n_words + word[first + 1], return_inverse=True)
        keys.append((n_words + pair) * n_docs + doc[row[first]])
        terms.append(pc.binary_join_element_wise(vocabulary.take(pa.array(pairs // n_words)), vocabulary.take(pa.array(pairs % n_words)), " ").cast(pa.string()))
        if len(vocabulary) < n_words:
            terms.insert(1, pa.nulls(n_words - len(vocabulary), pa.string()))
    key, tf = np.unique(np.concatenate(keys), return_counts=True)
    return ids.dictionary, pa.concat_arrays(terms), key // n_docs, key % n_docs, tf


_patterns: dict[str, list[str]] = {}


def token_patterns(spark: SparkSession) -> list[str]:
    """``TOKEN_PATTERN`` for Python, for texts of Latin-1, of 16-bit and of all characters: its letters and digits are
    those that Spark's own pattern finds among all code points, as ranges (asked once an application)."""
    app = spark.sparkContext.applicationId
    if app not in _patterns:
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        codes = spark.range(0x110000).where("id < 55296 or id > 57343").where(char.rlike(TOKEN_CLASS)).agg(F.sort_array(F.collect_list("id"))).first()[0]
        codes, found = np.asarray(codes), []
        for top in (0x100, 0x10000, 0x110000):
            own = codes[codes < top]
            first = np.append(True, np.diff(own) > 1)
            last = own[np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)]
            ranges = "[" + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(own[first].tolist(), last.tolist(), strict=True)) + "]"
            found.append(TOKEN_PATTERN.replace(TOKEN_CLASS, ranges).replace(r"\s", r"[ \t\n\x0b\f\r]"))
        _patterns[app] = found
    return _patterns[app]


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, lowered text), dealt and sorted by id."""
    return docs.select(id_col, text_col).repartition(dealt_parts(docs.sparkSession), id_col).sortWithinPartitions(id_col).select(id_col, F.lower(text_col).alias("_t"))


def tokenized(rows: Iterator[pa.RecordBatch], patterns: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Batches (id, tokens) of ``text_rows``; without patterns the rows have their tokens already."""
    if patterns is None:
        yield from rows
        return
    latin, bmp, whole = (re.compile(p).findall for p in patterns)

    def matches(text):
        try:
            text.encode("latin-1")
            return latin(text)
        except UnicodeEncodeError:
            return (bmp if len(text.encode("utf-16-le")) == 2 * len(text) else whole)(text)

    for batch in rows:
        for a in range(0, batch.num_rows, TEXT_ROWS):
            part = batch.slice(a, TEXT_ROWS)
            lists = [matches(text) if text else () for text in part.column(1).to_pylist()]
            offsets = np.append(0, np.cumsum([len(x) for x in lists]))
            flat = pa.array(list(chain.from_iterable(lists)), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)], ["_id", "_t"])


def term_hash(terms: pa.Array) -> np.ndarray:
    """A 64-bit hash of each term, the same in every process."""
    return pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)


def hash_order(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct terms by their hash (by the terms where hashes are equal), and the hashes in it."""
    hashed = term_hash(terms)
    order = np.argsort(hashed, kind="stable")
    if (hashed[order][1:] == hashed[order][:-1]).any():
        order = pc.sort_indices(pa.table({"h": hashed, "t": terms}), sort_keys=[("h", "ascending"), ("t", "ascending")]).to_numpy()
    return order, hashed[order]


def stream(table: pa.Table) -> bytes:
    """A table as one compressed Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def streams(column: pa.ChunkedArray) -> list[pa.Table]:
    """The tables of a column of Arrow streams."""
    return [pa.ipc.open_stream(s.as_buffer()).read_all() for s in column]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def block_cuts(hashed: np.ndarray) -> np.ndarray:
    """Where each block of terms begins and ends, in the order of their hash."""
    edges = np.arange(1, 1 << BLOCK_BITS, dtype=np.uint64) << np.uint64(64 - BLOCK_BITS)
    return np.concatenate([[0], np.searchsorted(hashed, edges), [len(hashed)]])


BLOCK_SCHEMA = "slice bigint, block int, docs bigint, grams bigint, size bigint, names binary, sizes binary, lists binary, ids binary"


def slice_blocks(rows: DataFrame, id_col: str, ngram_max: int, name: str, patterns: list[str] | None = None) -> DataFrame:
    """``slice_rows``, written once."""
    return materialize(slice_rows(rows, ngram_max, patterns), name)


def slice_rows(rows: DataFrame, ngram_max: int, patterns: list[str] | None = None) -> DataFrame:
    """The counts of rows (id, text, with the patterns of its tokens; or id, tokens), dealt and sorted by id, a row a slice and block:
    ``names`` (term, n: its documents, cf) in the order of the terms' hash, of ``size`` bytes, ``sizes`` (n) and
    ``lists`` (doc, tf: the terms' documents as numbers, one term after the other). Block 0 has the slice's documents: how many, how
    many grams, and ``ids`` (id, length), in the order of their numbers."""
    schema = to_arrow_schema(T._parse_datatype_string(BLOCK_SCHEMA))

    def count(batches):
        part = TaskContext.get().partitionId()
        for at, table in enumerate(sliced(tokenized(batches, patterns), ngram_max)):
            ids, terms, term, doc, tf = counted(table, ngram_max)
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            names, sizes = terms.take(pa.array(term[starts])), np.diff(starts, append=len(term))
            cf = np.add.reduceat(tf, starts) if len(starts) else tf
            lengths = np.bincount(doc, weights=tf, minlength=len(ids)).astype(np.int64)
            order, hashed = hash_order(names)
            cuts = block_cuts(hashed)
            for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a == b and block:
                    continue
                of, n = order[a:b], sizes[order[a:b]]
                own = ranges(starts[of], n)
                named = pa.table({"term": names.take(pa.array(of)), "n": pa.array(n.astype(np.int32)), "cf": pa.array(cf[of])})
                lists = pa.table({"doc": pa.array(doc[own].astype(np.int32)), "tf": pa.array(tf[own].astype(np.int32))})
                head = [len(ids), int(lengths.sum())] if block == 0 else [0, 0]
                yield pa.RecordBatch.from_pylist([{
                    "slice": (part << 32) + at, "block": block, "docs": head[0], "grams": head[1], "size": named.nbytes,
                    "names": stream(named), "sizes": stream(named.select(["n"])), "lists": stream(lists),
                    "ids": stream(pa.table({"id": ids, "length": pa.array(lengths)})) if block == 0 else None}], schema=schema)

    return rows.mapInArrow(count, BLOCK_SCHEMA)


SUM_SCHEMA = "slice bigint, block int, first int, data binary"


def term_sums(blocks: DataFrame, size: int, name: str) -> DataFrame:
    """The sums of all slices' names, written once: (slice, block, first, data): the df of the names from
    ``first`` on, and as slice -1 the vocabulary of a block in parts (term, df, cf)."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-size // GROUP_BYTES), min(4 * cores, -(-size // SMALL_GROUP)))
    schema = to_arrow_schema(T._parse_datatype_string(SUM_SCHEMA))

    def deal(batches):
        for batch in batches:
            for slice_, block, table in zip(batch.column("slice").to_pylist(), batch.column("block").to_pylist(), streams(batch.column("names")), strict=True):
                table = table.combine_chunks()
                if not table.num_rows:
                    continue
                group = ((term_hash(table.column("term").combine_chunks()) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.diff(group, prepend=-1))
                one = [stream(table.slice(a, b - a)) for a, b in zip(first, np.append(first[1:], len(group)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array([slice_] * len(first), pa.int64()), pa.array([block] * len(first), pa.int32()),
                                                  pa.array(first.astype(np.int32)), pa.array(one, pa.binary())], ["group", "slice", "block", "first", "names"])

    def add(messages: pa.Table) -> pa.Table:
        tables = streams(messages.column("names"))
        table = pa.concat_tables(tables)
        coded = table.column("term").combine_chunks().dictionary_encode()
        code, words_ = coded.indices.to_numpy(), coded.dictionary
        df, cf = (np.bincount(code, weights=table.column(c).to_numpy()).astype(np.int64) for c in ("n", "cf"))
        back, ends = df[code], np.cumsum([t.num_rows for t in tables])
        data = [stream(pa.table({"df": back[b - t.num_rows:b]})) for t, b in zip(tables, ends, strict=True)]
        block = (term_hash(words_) >> np.uint64(64 - BLOCK_BITS)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        named, blocks_ = [], []
        for a in np.flatnonzero(np.diff(block[order], prepend=-1)).tolist():
            of = pa.array(order[a:np.searchsorted(block[order], block[order[a]], side="right")])
            part = pa.table({"term": words_.take(of), "df": pa.array(df).take(of), "cf": pa.array(cf).take(of)})
            for i in range(0, part.num_rows, PACK_ROWS):
                named.append(stream(part.slice(i, PACK_ROWS)))
                blocks_.append(int(block[order[a]]))
        n = len(named)
        return pa.Table.from_arrays([
            pa.array(messages.column("slice").to_pylist() + [-1] * n, pa.int64()), pa.array(messages.column("block").to_pylist() + blocks_, pa.int32()),
            pa.array(messages.column("first").to_pylist() + [0] * n, pa.int32()), pa.array(data + named, pa.binary())], schema=schema)

    dealt = blocks.select("slice", "block", "names").mapInArrow(deal, "group bigint, slice bigint, block int, first int, names binary")
    return materialize(dealt.groupBy("group").applyInArrow(add, SUM_SCHEMA), name)


def unpacked(rows: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    """The rows of a column of Arrow streams, with the columns ``keep``; read where they are used."""
    out = T.StructType([rows.schema[k] for k in keep] + T._parse_datatype_string(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for i, table in enumerate(streams(batch.column(column))):
                for part in table.combine_chunks().to_batches(max_chunksize=SLICE_BATCH):
                    kept = [pa.array([batch.column(k)[i].as_py()] * part.num_rows, arrow.field(k).type) for k in keep]
                    yield pa.RecordBatch.from_arrays(kept + part.columns, names=arrow.names).cast(arrow)

    return rows.select(*keep, column).mapInArrow(run, out)


def wanted_by_block(terms: DataFrame, hint: Callable) -> DataFrame:
    """(block, wanted): the rows of ``terms`` (term, _term, ...) by the block that can hold the term."""
    return hint(by_block(terms).groupBy("block").agg(F.collect_list(F.struct(*terms.columns)).alias("wanted")))


def by_block(terms: DataFrame) -> DataFrame:
    """The rows of ``terms`` with the ``block`` of each term."""
    def key(batches):
        for batch in batches:
            block = (term_hash(batch.column("term")) >> np.uint64(64 - BLOCK_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])

    return terms.mapInArrow(key, T.StructType([T.StructField("block", T.IntegerType()), *terms.schema.fields]))


def found_terms(wanted: pa.Scalar, terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places in ``terms`` of those wanted, and their numbers."""
    asked = wanted.values
    place = pc.index_in(terms, value_set=asked.field("term")).combine_chunks() if isinstance(terms, pa.ChunkedArray) else pc.index_in(terms, value_set=asked.field("term"))
    at = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    return at, asked.field("_term").take(place.take(pa.array(at)))


def block_hits(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slice, _term, docs, tfs) of the wanted terms."""
    out = "slice bigint, _term bigint, docs array<int>, tfs array<int>"
    schema = to_arrow_schema(T._parse_datatype_string(out))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                names = streams(one.column("names"))[0].column("term").combine_chunks()
                at, numbers = found_terms(one.column("wanted")[0], names)
                if len(at):
                    n = streams(one.column("sizes"))[0].column("n").to_numpy().astype(np.int64)
                    lists = streams(one.column("lists"))[0].take(pa.array(ranges((np.cumsum(n) - n)[at], n[at]))).combine_chunks()
                    offsets = pa.array(np.append(0, np.cumsum(n[at])).astype(np.int32))
                    each = [pa.ListArray.from_arrays(offsets, lists.column(c).combine_chunks()) for c in ("doc", "tf")]
                    slice_ = pa.array([one.column("slice")[0].as_py()] * len(at), pa.int64())
                    yield from pa.Table.from_arrays([slice_, numbers, *each], names=schema.names).cast(schema).to_batches()

    return blocks.select("slice", "block", "names", "sizes", "lists").join(wanted, "block").drop("block").mapInArrow(run, out)


def looked_up(sums: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, cf) of ``terms`` (term) that are in the vocabulary, found in its blocks."""
    hint = F.broadcast if fits(terms) else (lambda df: df)
    out = "term string, df bigint, cf bigint"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                table = streams(batch.slice(i, 1).column("data"))[0].combine_chunks()
                at, _ = found_terms(batch.column("wanted")[i], table.column("term").combine_chunks())
                yield from table.take(pa.array(at)).to_batches()

    wanted = wanted_by_block(terms.select("term").distinct().withColumn("_term", F.lit(0).cast("bigint")), hint)
    return sums.where("slice = -1").select("block", "data").join(wanted, "block").select("data", "wanted").mapInArrow(run, out)


@dataclass
class TfidfIndex:
    postings: DataFrame
    vocab: DataFrame
    norms: DataFrame
    n_docs: int | None  # None: not counted yet (see doc_count)
    id_col: str = "doc_id"
    ngram_max: int = 2
    slice_norms: DataFrame | None = None  # slice, id, norm, n_terms
    blocks: DataFrame | None = None  # slice_blocks
    sums: DataFrame | None = None  # term_sums
    slice_docs: DataFrame | None = None  # slice, ids, norms, n_terms: a row a slice
    n_texts: int | None = None  # documents with and without a gram: the N of idf
    texts: "SliceTexts | None" = None  # if the counts weren't written

    @property
    def stored(self) -> DataFrame | None:
        """(slice, term, n, cf): a row a term and slice."""
        return None if self.blocks is None else unpacked(self.blocks, "names", "term string, n int, cf bigint", "slice")

    def known(self, terms: DataFrame) -> DataFrame:
        """(term, idf) of the vocabulary, of ``terms`` (term) at least."""
        if self.sums is None:
            return self.vocab.select("term", "idf")
        return looked_up(self.sums, terms).select("term", idf_expr(self.n_texts).alias("idf"))

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.norms.write.mode("overwrite").parquet(f"{path}/norms")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.doc_count(), self.id_col, self.ngram_max)],
                              "n_docs long, id_col string, ngram_max int") \
            .write.mode("overwrite").json(f"{path}/meta")

    def doc_count(self) -> int:
        """Documents that have at least one gram (one action, only when saving)."""
        if self.n_docs is None:
            self.n_docs = int(self.norms.count())
        return self.n_docs

    @staticmethod
    def load(spark, path: str) -> "TfidfIndex":
        meta = spark.read.json(f"{path}/meta").first()
        return TfidfIndex(spark.read.parquet(f"{path}/postings"),
                          spark.read.parquet(f"{path}/vocab"),
                          spark.read.parquet(f"{path}/norms"),
                          int(meta["n_docs"]), meta["id_col"], int(meta["ngram_max"]))


def idf_expr(n_docs: int, df_col="df"):
    return F.log(F.lit(float(1 + n_docs)) / (F.lit(1.0) + F.col(df_col))) + F.lit(1.0)


#: Characters of a token and the gap behind it, bytes of a gram's name, and grams of a slice in small corpora.
TOKEN_CHARS, NAME_BYTES, SMALL_SLICE = 6, 12, 250_000


@dataclass
class SliceTexts:
    """Documents dealt by id into slices, as texts (or lists of tokens): whoever needs a slice's counts takes them again.
    Texts are a fifth of their counts' bytes, so a corpus that is read twice moves less than counts that are written."""

    rows: DataFrame  # slice, _id, _t
    patterns: list[str] | None
    ngram_max: int
    n_docs: int
    grams: int  # as the lengths of the texts tell

    @staticmethod
    def of(docs: DataFrame, id_col: str, value_col: str, ngram_max: int, grams, patterns: list[str] | None = None) -> "SliceTexts":
        """``docs`` (id, text or tokens); ``grams``: a column, about how many grams a row has."""
        n, null, size = docs.agg(F.count_distinct(id_col), F.max(F.col(id_col).isNull().cast("int")), F.sum(grams)).first()
        size, cores = int(size or 0), docs.sparkSession.sparkContext.defaultParallelism
        slices = max(1, -(-size // SLICE_GRAMS), min(2 * cores, -(-size // SMALL_SLICE)))
        rows = docs.select(F.pmod(F.xxhash64(id_col), F.lit(slices)).alias("slice"), F.col(id_col).alias("_id"), F.col(value_col).alias("_t"))
        rows = rows.repartition(dealt_parts(docs.sparkSession), "slice")  # a task's work is more than its bytes tell
        return SliceTexts(rows, patterns, ngram_max, n + (null or 0), size)

    def counter(self) -> Callable:
        """Ids, names in the order of their hash and the hashes, and per posting its name's place, document and count, of a slice's rows."""
        patterns, ngram_max = self.patterns, self.ngram_max

        def run(rows: pa.Table):
            batches = rows.select(["_id", "_t"]).to_batches()
            counts = list(tokenized(iter(batches), patterns))
            table = pa.Table.from_batches(counts) if counts else rows.select(["_id", "_t"]).slice(0, 0)
            ids, terms, term, doc, tf = counted(table, ngram_max)
            first = term[np.flatnonzero(np.diff(term, prepend=-1))]
            names = terms.take(pa.array(first))
            order, hashed = hash_order(names)
            place = np.empty(len(terms), np.int64)
            place[first[order]] = np.arange(len(order))
            return ids, names.take(pa.array(order)), hashed, place[term], doc, tf

        return run

    def sums(self, name: str) -> DataFrame:
        """``term_sums`` of the slices' names."""
        count = self.counter()
        schema = to_arrow_schema(T._parse_datatype_string("slice bigint, block int, names binary"))

        def run(rows: pa.Table) -> pa.Table:
            _, names, hashed, term, _, tf = count(rows)
            table = pa.table({"term": names, "n": pa.array(np.bincount(term, minlength=len(names)).astype(np.int32)),
                              "cf": pa.array(np.bincount(term, tf, len(names)).astype(np.int64))})
            cuts, slice_ = block_cuts(hashed), rows.column("slice")[0].as_py()
            return pa.Table.from_pylist([{"slice": slice_, "block": block, "names": stream(table.slice(a, b - a))}
                                         for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a], schema=schema)

        named = self.rows.groupBy("slice").applyInArrow(run, T._parse_datatype_string("slice bigint, block int, names binary"))
        return term_sums(named, NAME_BYTES * self.grams, name)

    def with_sums(self, sums: DataFrame, run: Callable, schema) -> DataFrame:
        """``run`` (the slice, what ``counter`` gives and the terms' df) for every slice: its texts meet the sums that came back to it."""
        count = self.counter()

        def each(rows: pa.Table, back: pa.Table) -> pa.Table:
            back = back.sort_by([("block", "ascending"), ("first", "ascending")])
            df = pa.concat_tables(streams(back.column("data"))).column("df").to_numpy() if back.num_rows else np.zeros(0, np.int64)
            return run(rows.column("slice")[0].as_py(), *count(rows), df)

        return self.rows.groupBy("slice").cogroup(sums.where("slice >= 0").groupBy("slice")).applyInArrow(each, schema)


def tfidf_weights(n_texts: int, df: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (tf * idf) of a slice's postings and the norms of its documents."""
    weight = tf * (np.log((1.0 + n_texts) / (1.0 + df)) + 1.0)[term]
    return weight, np.sqrt(np.bincount(doc, weight * weight, minlength=n_docs))


def fit_uncounted(docs: DataFrame, id_col: str, text_col: str, ngram_max: int) -> TfidfIndex:
    """``fit_tfidf`` without written counts: postings are counted from the texts whenever they are read."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    lowered = docs.select(id_col, F.lower(text_col).alias("_t"), F.length(text_col).alias("_n"))
    texts = SliceTexts.of(lowered, id_col, "_t", ngram_max, F.col("_n") * ngram_max / TOKEN_CHARS, token_patterns(spark))
    sums, n_texts = texts.sums("tfidf-sums"), texts.n_docs
    vocab = unpacked(sums.where("slice = -1"), "data", "term string, df bigint, cf bigint").withColumn("idf", idf_expr(n_texts))
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("term", T.StringType()),
                        T.StructField("tf", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("norm", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(slice_, ids, names, hashed, term, doc, tf, df):
        weight, norm = tfidf_weights(n_texts, df, term, doc, tf, len(ids))
        order = np.argsort(doc, kind="stable")
        return pa.Table.from_arrays([ids.take(pa.array(doc[order])), names.take(pa.array(term[order])), pa.array(tf[order].astype(np.int64)),
                                     pa.array((weight / norm[doc])[order]), pa.array(norm[doc[order]])], names=schema.names).cast(schema)

    rows = texts.with_sums(sums, run, out)
    norms = rows.groupBy(id_col).agg(F.first("norm").alias("norm"), F.count(F.lit(1)).alias("n_terms"))
    return TfidfIndex(rows.drop("norm"), vocab, norms, None, id_col, ngram_max, sums=sums, n_texts=n_texts, texts=texts)


def fit_tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              ngram_max: int = 2, persist: bool = False, write_counts: bool = True) -> TfidfIndex:
    """Fit the index over all non-null documents (F1 drops null texts).

    N (the number of documents) and the size of the names are sums over the written blocks.
    Without ``write_counts`` only the sums over all documents are written (see ``SliceTexts``)."""
    docs = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    if not write_counts:
        return fit_uncounted(docs, id_col, text_col, ngram_max)
    blocks = slice_blocks(text_rows(docs, id_col, text_col), id_col, ngram_max, "tfidf-blocks", token_patterns(docs.sparkSession))
    return index_of_blocks(blocks, id_col, docs.schema[id_col].dataType, ngram_max, persist)


def without(blocks: DataFrame) -> DataFrame:
    """``blocks`` (slice_rows and ``dead``: a bit a document) with the documents that aren't dead, numbered anew."""
    columns = [c for c in blocks.columns if c != "dead"]
    schema = to_arrow_schema(T.StructType([blocks.schema[c] for c in columns]))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dead = np.unpackbits(np.frombuffer(row.pop("dead"), np.uint8), bitorder="little").astype(bool)
                before = np.append(0, np.cumsum(dead))  # dead documents with a lower number
                named, lists = (pa.ipc.open_stream(row[c]).read_all().combine_chunks() for c in ("names", "lists"))
                doc, tf = lists.column("doc").to_numpy(), lists.column("tf").to_numpy()
                keep = ~np.append(dead, False)[np.minimum(doc, len(dead))]
                term = np.repeat(np.arange(named.num_rows), named.column("n").to_numpy())[keep]
                doc, tf = doc[keep], tf[keep]
                n, cf = (np.bincount(term, weights, named.num_rows).astype(np.int64) for weights in (None, tf))
                of = np.flatnonzero(n)
                named = pa.table({"term": named.column("term").take(pa.array(of)), "n": pa.array(n[of].astype(np.int32)), "cf": pa.array(cf[of])}).combine_chunks()
                if row["ids"] is not None:
                    ids = pa.ipc.open_stream(row["ids"]).read_all().combine_chunks()
                    ids = ids.filter(pa.array(~np.append(dead, np.zeros(max(0, ids.num_rows - len(dead)), bool))[:ids.num_rows]))
                    row |= {"ids": stream(ids), "docs": ids.num_rows, "grams": pc.sum(ids.column("length")).as_py() or 0}
                if len(of) or row["docs"]:
                    lists = pa.table({"doc": pa.array((doc - before[np.minimum(doc, len(dead))]).astype(np.int32)), "tf": pa.array(tf)})
                    row |= {"size": named.nbytes, "names": stream(named), "sizes": stream(named.select(["n"])), "lists": stream(lists)}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return blocks.mapInArrow(run, T.StructType([blocks.schema[c] for c in columns]))


def by_slice(blocks: DataFrame, sums: DataFrame, *columns: str):
    """The blocks of a slice and the sums that came back to it, grouped by one shuffle of both."""
    return blocks.select("slice", "block", *columns).unionByName(sums.where("slice >= 0"), allowMissingColumns=True).groupBy("slice")


def slice_counts(rows: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]:
    """Documents (id, length), the terms' numbers of documents, lists (doc, tf) and the terms' df of one slice."""
    own = rows.filter(pc.is_valid(rows.column("lists"))).sort_by("block")
    sums = rows.filter(pc.is_valid(rows.column("data"))).sort_by([("block", "ascending"), ("first", "ascending")])
    df = pa.concat_tables(streams(sums.column("data"))).column("df").to_numpy() if sums.num_rows else np.zeros(0, np.int64)
    sizes = pa.concat_tables(streams(own.column("sizes"))).column("n").to_numpy()
    return streams(own.column("ids").slice(0, 1))[0], sizes, pa.concat_tables(streams(own.column("lists"))).combine_chunks(), df


def slice_weights(rows: pa.Table, n_texts: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a slice, and per posting its term's place, document and tf * idf, with the documents' norms and tfs."""
    docs, sizes, lists, df = slice_counts(rows)
    doc, tf = lists.column("doc").to_numpy(), lists.column("tf").to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    weight = tf * (np.log((1.0 + n_texts) / (1.0 + df)) + 1.0)[row]
    norm = np.sqrt(np.bincount(doc, weight * weight, minlength=docs.num_rows))
    return docs.column("id").combine_chunks(), row, doc, weight, norm, tf


def slice_documents(blocks: DataFrame, sums: DataFrame, id_type: T.DataType, n_texts: int) -> DataFrame:
    """(slice, ids, norms, n_terms): the documents of a slice in the order of their numbers."""
    out = T.StructType([T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                        T.StructField("norms", T.ArrayType(T.DoubleType())), T.StructField("n_terms", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(out)

    def run(rows: pa.Table) -> pa.Table:
        ids, _, doc, _, norm, _ = slice_weights(rows, n_texts)
        offsets = pa.array([0, len(ids)], pa.int32())
        each = [ids, pa.array(norm), pa.array(np.bincount(doc, minlength=len(ids)).astype(np.int64))]
        return pa.Table.from_arrays([rows.column("slice").slice(0, 1), *(pa.ListArray.from_arrays(offsets, x) for x in each)], names=schema.names).cast(schema)

    return by_slice(blocks, sums, "sizes", "lists", "ids").applyInArrow(run, out)


def slice_postings(blocks: DataFrame, sums: DataFrame, id_col: str, id_type: T.DataType, n_texts: int) -> DataFrame:
    """(id, term, tf, w), documents together: postings are rows only where a slice's blocks meet their sums."""
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("term", T.StringType()),
                        T.StructField("tf", T.LongType()), T.StructField("w", T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(rows: pa.Table) -> pa.Table:
        ids, row, doc, weight, norm, tf = slice_weights(rows, n_texts)
        own = rows.filter(pc.is_valid(rows.column("names"))).sort_by("block")
        terms = pa.concat_tables(streams(own.column("names"))).column("term").combine_chunks()
        order = np.argsort(doc, kind="stable")
        batches = [order[a:a + SLICE_BATCH] for a in range(0, len(order), SLICE_BATCH)]
        parts = [pa.Table.from_arrays([ids.take(pa.array(doc[b])), terms.take(pa.array(row[b])), pa.array(tf[b].astype(np.int64)),
                                       pa.array(weight[b] / norm[doc[b]])], names=schema.names).cast(schema) for b in batches]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return by_slice(blocks, sums, "names", "sizes", "lists", "ids").applyInArrow(run, out)


def block_totals(blocks: DataFrame) -> tuple[int, int, int]:
    """Documents, grams and bytes of names of all slices."""
    return tuple(int(n or 0) for n in blocks.agg(F.sum("docs"), F.sum("grams"), F.sum("size")).first())


def index_of_blocks(blocks: DataFrame, id_col: str, id_type: T.DataType, ngram_max: int = 2, persist: bool = False) -> TfidfIndex:
    """The index of ``slice_blocks``."""
    n_texts, _, size = block_totals(blocks)
    sums = term_sums(blocks, size, "tfidf-sums")
    vocab = unpacked(sums.where("slice = -1"), "data", "term string, df bigint, cf bigint").withColumn("idf", idf_expr(n_texts))
    docs = slice_documents(blocks, sums, id_type, n_texts)
    if persist:
        docs = materialize(docs, "tfidf-norms")
    each = docs.select("slice", F.inline(F.arrays_zip("ids", "norms", "n_terms"))).withColumnsRenamed({"ids": id_col, "norms": "norm"})
    norms = each.where("n_terms > 0")
    postings = slice_postings(blocks, sums, id_col, id_type, n_texts)
    return TfidfIndex(postings, vocab, norms.select(id_col, "norm", "n_terms"), None, id_col, ngram_max, norms, blocks, sums, docs, n_texts)


def query_vectors(index: TfidfIndex, queries: DataFrame, qid: str = "query_id",
                  qtext: str = "query", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
    """(qid, term, qw, idf): L2-normalised query weights over in-vocabulary grams.

    Returns the frame and whether it is proven small: the check runs on the
    query-side counts only (cheap), and the weighted rows are a subset of them."""
    qtf = term_counts(queries.select(qid, qtext).where(F.col(qtext).isNotNull()), qid, qtext,
                      index.ngram_max)
    if index.sums is not None:
        qtf = materialize(qtf, "query-terms")  # the vocabulary's blocks are asked for these terms
    small = fits(qtf, max_broadcast_rows)
    if small:
        qtf = F.broadcast(qtf)
    qv = qtf.join(index.known(qtf), "term").withColumn(
        "qw", F.col("tf") * F.col("idf"))
    qn = Window.partitionBy(qid)
    return qv.select(qid, "term",
                     (F.col("qw") / F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(qn))).alias("qw"), "idf"), small


def score(index: TfidfIndex, queries: DataFrame, qid: str = "query_id", qtext: str = "query",
          digits: int = 6, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(qid, doc_id, score) for every doc sharing at least one gram with the query."""
    qv, small = query_vectors(index, queries, qid, qtext, max_broadcast_rows)
    qv = F.broadcast(qv.drop("idf")) if small else qv.drop("idf")
    id_col = index.id_col
    return (index.postings.select(id_col, "term", "w").join(qv, "term")
            .groupBy(qid, id_col).agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
            .withColumn("score", F.round("score", digits)))


def _slice_topk(weigh: Callable, k: int, digits: int, positive_only: bool, schema: pa.Schema) -> Callable:
    """The k best documents of each query of a block within one slice, ties to the smaller id."""

    def run(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        if not corpus.num_rows or not queries.num_rows:
            return schema.empty_table()
        corpus, queries = corpus.combine_chunks(), queries.combine_chunks()
        own = corpus.filter(pc.equal(corpus.column("_term"), -1))
        ids, norm = (own.column(c).combine_chunks().flatten() for c in ("_ids", "_norms"))
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # documents by id
        names, norm = ids.take(pa.array(order)), norm.to_numpy()[order]
        corpus = corpus.filter(pc.not_equal(corpus.column("_term"), -1)).combine_chunks()
        lists, term = corpus.column("docs").combine_chunks(), corpus.column("_term").to_numpy()
        of = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        doc = place[lists.flatten().to_numpy()]
        value = weigh(corpus.column("tfs").combine_chunks().flatten().to_numpy().astype(np.float64), norm[doc])
        at = {t: i for i, t in enumerate(term.tolist())}
        rows, asked, scores = [], [], []
        for i, (ts, qws) in enumerate(zip(queries.column("_terms").to_pylist(), queries.column("_qws").to_pylist(), strict=True)):
            total, seen = np.zeros(len(order)), np.zeros(len(order), bool)
            for t, qw in zip(ts, qws, strict=True):
                r = at.get(t)
                if r is not None:
                    d = doc[of[r]:of[r + 1]]
                    total[d] += value[of[r]:of[r + 1]] * qw
                    seen[d] = True
            total = np.round(total, digits)
            hit = np.flatnonzero(seen & (total > 0) if positive_only else seen)
            s = total[hit]
            if len(hit) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                hit, s = hit[keep], s[keep]
            best = np.lexsort((hit, -s))[:k]
            rows.append(hit[best])
            scores.append(s[best])
            asked.append(np.full(len(best), i))
        rows, asked, scores = (np.concatenate(x) for x in (rows, asked, scores))
        return pa.Table.from_arrays([queries.column("_q").take(pa.array(asked)), names.take(pa.array(rows)), pa.array(scores)], schema=schema)

    return run


def sliced_search(blocks: DataFrame, docs: DataFrame, qv: DataFrame, k: int, qid: str, id_col: str, weigh: Callable,
                  positive_only: bool = True, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank) for ``qv`` (qid, term, qw): ``qw`` times ``weigh(tf, norm of the document)``,
    summed over the query's terms. ``docs`` (slice, ids, norms) has a row a slice of ``blocks``. Slices and blocks
    of queries meet in a grid of cells, which keep k rows a query; neither side is collected."""
    qv = materialize(qv.select(F.col(qid).alias("_q"), "term", "qw"), "search-queries")
    terms = materialize(qv.select("term").distinct().withColumn("_term", F.monotonically_increasing_id()), "search-terms")
    small = fits(qv)
    hint = F.broadcast if small else (lambda df: df)
    q = qv.join(hint(terms), "term").groupBy("_q").agg(F.collect_list(F.struct("_term", "qw")).alias("_l"))
    parts = max(1, -(-qv.select("_q").distinct().count() // QUERY_BLOCK))
    q = q.select("_q", F.pmod(F.xxhash64("_q"), F.lit(parts)).cast("int").alias("_block"), F.col("_l._term").alias("_terms"), F.col("_l.qw").alias("_qws"))
    q = blocks.where("ids is not null").select(F.col("slice").alias("_cell")).crossJoin(hint(q))
    hits = block_hits(blocks, wanted_by_block(terms, hint)).withColumnRenamed("slice", "_cell")
    own = docs.select(F.col("slice").alias("_cell"), F.lit(-1).cast("long").alias("_term"), F.col("ids").alias("_ids"), F.col("norms").alias("_norms"))
    corpus = hits.unionByName(own, allowMissingColumns=True).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    id_type = docs.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("_q", qv.schema["_q"].dataType), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    cells = corpus.groupBy("_cell", "_block").cogroup(q.groupBy("_cell", "_block"))
    found = cells.applyInArrow(_slice_topk(weigh, k, digits, positive_only, to_arrow_schema(out)), out)
    return top_k(found, "_q", [F.col("score").desc(), F.col(id_col)], k).withColumnRenamed("_q", qid)


def search(index: TfidfIndex, queries: DataFrame, k: int, qid: str = "query_id",
           qtext: str = "query", positive_only: bool = True, digits: int = 6) -> DataFrame:
    """Top-k docs per query by cosine score; ties by doc id (R4 without filters)."""
    if index.blocks is None:
        s = score(index, queries, qid, qtext, digits)
        if positive_only:
            s = s.where(F.col("score") > 0)
        return top_k(s, qid, [F.col("score").desc(), F.col(index.id_col)], k)
    qv, _ = query_vectors(index, queries, qid, qtext)
    qv = qv.select(qid, "term", (F.col("qw") * F.col("idf")).alias("qw"))
    return sliced_search(index.blocks, index.slice_docs, qv, k, qid, index.id_col, lambda tf, norm: tf / norm, positive_only, digits)


def pad_zero_scores(ranked: DataFrame, index: TfidfIndex, queries: DataFrame, k: int,
                    qid: str = "query_id") -> DataFrame:
    """Opt-in padding: queries with fewer than k positive hits take lowest-id
    unmatched documents with score 0 (the full-argsort behaviour).

    A query has at most k - 1 hits, so the 2k - 1 lowest ids always hold k
    unmatched ones: that bounded id list travels as a literal array."""
    id_col = index.id_col
    low_ids = [r[0] for r in index.norms.select(id_col).orderBy(id_col).limit(2 * k).collect()]
    counts = ranked.groupBy(qid).agg(F.count(F.lit(1)).alias("n_hit"))
    need = (queries.select(qid).distinct().join(counts, qid, "left")
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).where(F.col("n_hit") < k))
    fill = (need.withColumn(id_col, F.explode(F.array(*[F.lit(i) for i in low_ids])))
            .join(ranked.select(qid, id_col), [qid, id_col], "left_anti")
            .withColumn("score", F.lit(0.0)))
    w = Window.partitionBy(qid).orderBy(id_col)
    fill = (fill.withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= F.lit(k) - F.col("n_hit"))
            .withColumn("rank", F.col("n_hit") + F.col("_r")).select(qid, id_col, "score", "rank"))
    return ranked.select(qid, id_col, "score", "rank").unionByName(fill)


# --------------------------------------------------------------------------- BM25


def bm25_lengths(blocks: DataFrame, id_type: T.DataType) -> DataFrame:
    """(slice, ids, lengths): the documents of a slice in the order of their numbers."""
    out = T.StructType([T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for i, docs in enumerate(streams(batch.column("ids"))):
                docs, offsets = docs.combine_chunks(), pa.array([0, docs.num_rows], pa.int32())
                each = [pa.ListArray.from_arrays(offsets, docs.column(c).combine_chunks()) for c in ("id", "length")]
                yield pa.RecordBatch.from_arrays([batch.column("slice").slice(i, 1), *each], names=schema.names).cast(schema)

    return blocks.where("ids is not null").select("slice", "ids").mapInArrow(run, out)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id",
                doc_terms_col: str = "terms", qid: str = "query_id", q_terms_col: str = "q_terms",
                k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON,
                digits: int = 6) -> DataFrame:
    """Okapi BM25 over pre-tokenised rows.

    ``docs(id, terms array)`` and ``queries(qid, q_terms array)``; repeated query
    terms count once each time they appear. idf = ln((N - df + 0.5)/(df + 0.5));
    negative idf is replaced by ``epsilon * mean idf``."""
    terms = docs.select(id_col, F.col(doc_terms_col).alias("_t"))
    rows = terms.repartition(dealt_parts(docs.sparkSession), id_col).sortWithinPartitions(id_col)
    blocks = slice_blocks(rows, id_col, 1, "bm25-blocks")
    n_docs, length, size = block_totals(blocks)
    sums = term_sums(blocks, size, "bm25-sums")
    avgdl = length / n_docs if length else 1.0
    qv = bm25_query_vectors(Bm25Index(sums, n_docs, avgdl, k1, b, epsilon, id_col), queries, qid, q_terms_col)
    lengths = bm25_lengths(blocks, rows.schema[id_col].dataType)
    norms = lengths.select("slice", "ids", F.transform("lengths", lambda dl: F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(avgdl))).alias("norms"))
    # every document with a query term is ranked: in small corpora the floor of the idf,
    # and with it a true hit's score, can be negative
    return sliced_search(blocks, norms, qv, k, qid, id_col, lambda tf, norm: tf * (k1 + 1) / (tf + norm), False, digits)


@dataclass
class Bm25Index:
    """Query-independent halves of ``bm25_search``: the documents' terms and the sums over them."""

    sums: DataFrame  # term_sums
    n_docs: int
    avgdl: float
    k1: float
    b: float
    epsilon: float
    id_col: str
    texts: SliceTexts | None = None

    def known(self, terms: DataFrame) -> DataFrame:
        """(term, idf) of ``terms`` (term) that are in the vocabulary; a negative idf is ``epsilon`` times the mean."""
        idf = F.log((F.lit(float(self.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        raw = unpacked(self.sums.where("slice = -1"), "data", "term string, df bigint, cf bigint").select(idf.alias("idf"))
        mean_idf = raw.agg(F.coalesce(F.avg("idf"), F.lit(0.0))).scalar()
        return looked_up(self.sums, terms).select("term", F.when(idf < 0, F.lit(self.epsilon) * mean_idf).otherwise(idf).alias("idf"))


def bm25_index(docs: DataFrame, id_col: str = "doc_id", doc_terms_col: str = "terms", k1: float = BM25_K1,
               b: float = BM25_B, epsilon: float = BM25_EPSILON) -> Bm25Index:
    """The index of ``docs`` (id, terms array), whose counts aren't written (see ``SliceTexts``)."""
    own = docs.select(id_col, F.col(doc_terms_col).alias("_t"))
    texts = SliceTexts.of(own, id_col, "_t", 1, F.coalesce(F.greatest(F.size("_t"), F.lit(0)), F.lit(0)))
    return Bm25Index(texts.sums("bm25-sums"), texts.n_docs, texts.grams / texts.n_docs if texts.grams else 1.0, k1, b, epsilon, id_col, texts)


def bm25_query_vectors(index: Bm25Index, queries: DataFrame, qid: str = "query_id", q_terms_col: str = "q_terms") -> DataFrame:
    """(qid, term, qw): term counts times idf, over in-vocabulary terms."""
    q = materialize(queries.select(qid, explode_nonempty(q_terms_col, "term")).where(F.col("term").isNotNull())
                    .groupBy(qid, "term").agg(F.count(F.lit(1)).alias("qtf")), "bm25-queries")
    return (F.broadcast(q) if fits(q) else q).join(index.known(q), "term").select(qid, "term", (F.col("qtf") * F.col("idf")).alias("qw"))


__all__ = ["bm25_index", "bm25_query_vectors", "TfidfIndex", "fit_tfidf", "query_vectors", "score", "search", "pad_zero_scores",
           "term_counts", "bm25_search", "words"]


def bm25_doc_terms(text, sections=None, weights=None) -> "Column":
    """R14 document tokens: for each known section present in the lowercased text,
    the whitespace tokens between its header and the next '===', repeated
    int(weight) times (intended section names, Q8)."""
    from tessera.config import BM25_SECTION_KEYS, BM25_SECTION_WEIGHTS, BM25_SECTIONS
    sections = sections or BM25_SECTIONS
    weights = weights or {s: BM25_SECTION_WEIGHTS[BM25_SECTION_KEYS[s]] for s in sections}
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    parts = []
    for s in sections:
        marker = f"=== {s} ==="
        body = F.element_at(F.split(F.element_at(F.split(t, marker), 2), "==="), 1)
        toks = words(F.coalesce(body, F.lit("")))
        rep = int(weights[s])
        parts.append(F.when(F.instr(t, marker) > 0, F.flatten(F.array_repeat(toks, rep)))
                     .otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def bm25_query_terms(query, parts, part_weights=None) -> "Column":
    """R14 query tokens: each found part's words repeated int(weight) times, then
    the lowercased query's whitespace words."""
    from tessera.config import BM25_QUERY_PART_WEIGHTS
    part_weights = part_weights or BM25_QUERY_PART_WEIGHTS
    p = F.col(parts) if isinstance(parts, str) else parts
    arrs = []
    for f in ["course", "professor", "term", "campus"]:
        rep = int(part_weights.get(f, 1.0))
        arrs.append(F.when(p[f].isNotNull(), F.flatten(F.array_repeat(words(p[f]), rep)))
                    .otherwise(F.array().cast("array<string>")))
    q = F.col(query) if isinstance(query, str) else query
    return F.concat(*arrs, words(q))
