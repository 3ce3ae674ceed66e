"""Ranked lexical search by NRA (no random access).

Three passes:

1. ``postings``: every whole text is cut into terms once; a document keeps its
   length and the counts of the terms that the queries use (one stored row per
   document, no shuffle of terms).
2. document frequencies of those terms, N and L are summed from the stored rows.
3. ``search``: a task reads stored rows into runs of at most ``RUN_POSTINGS``
   postings, turns each run into impact-sorted lists and answers every query by
   NRA: rounds of sequential reads, the next block of each list of the query,
   with a lower bound (what was read of a document) and an upper bound (that,
   plus the last impact read of every list in which the document hasn't been
   seen) per document. A query is done when no unseen document can enter, no
   seen one outside can overtake, and the bounds of all that may belong have
   met, so members, ties and scores are exact. The k-th score of earlier runs
   of the task is a cutoff for later ones. A task returns k rows a query; a
   partial top-k and one shuffle of those rows merge the tasks.

Scores are integers: a term's weight w is floor(1000 ln((2N+2)/(2df+1))), a
posting adds w * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L.

Bounds: the queries come to the driver in blocks of ``QUERY_BLOCK`` rows (more
queries make more passes over the stored rows); broadcast are their terms and
weights; a task holds one run. Nothing else grows outside Spark.

Defined results: null texts and texts without a term are no documents (they
count neither for N nor for L); a query that is null or without a term has no
rows; rows are documents of their own, also if an id or a text repeats; equal
scores go by ascending id, null ids last; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

#: Queries of a pass, postings of a run, and the first block read of a list (blocks double).
QUERY_BLOCK, RUN_POSTINGS, FIRST_BLOCK = 2_000, 1_500_000, 256
#: Documents times lists of a query whose seen marks a task holds; a run is read in parts beyond that.
MARKS = 50_000_000
#: Bytes of text whose terms a task holds at a time (one longer text is held alone).
SLICE_BYTES = 2_000_000

# Every ASCII byte but letters and digits ends a term; A-Z are lower-cased; all else stays.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return text.translate(_TERM_BYTES).split()


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        if held and size + len(t) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def postings(documents: DataFrame, vocabulary: dict[bytes, int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n, terms and tfs of every document that has a term: n counts all of
    its terms, the two arrays hold those of ``vocabulary`` and their numbers."""
    shipped = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        code, width = shipped.value.get, len(shipped.value) + 1
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            for some in _slices(texts):
                words = [terms(t) for t in some]
                n = np.array([len(w) for w in words], np.int64)
                codes = np.fromiter((c for w in words for c in map(code, w, repeat(-1))), np.int64, int(n.sum()))
                doc = np.repeat(np.arange(len(some)), n)
                known = codes >= 0
                keys, tfs = np.unique(doc[known] * width + codes[known], return_counts=True)
                starts = np.searchsorted(keys, np.arange(len(some) + 1) * width)
                has = np.flatnonzero(n)
                offsets = pa.array(np.concatenate([starts[has], starts[-1:]]), pa.int32())
                # a document without a term has no postings, so those of the others are adjacent
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(some)).take(pa.array(has)), pa.array(n[has]),
                    pa.ListArray.from_arrays(offsets, pa.array(keys % width, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], ["doc_id", "n", "terms", "tfs"])
                at += len(some)

    return documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Corpus:
    """Number of documents, all their terms, and document frequencies by term code."""

    def __init__(self, rows: DataFrame):
        total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        self.docs, self.words = total["docs"], total["words"] or 0
        # at most as many rows as the queries have terms
        self.df = {r["term"]: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * self.df.get(term, 0) + 1)))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        if len(n) and int(n.max()) * 75 * self.docs >= 1 << 63:
            return np.array([25 + 75 * int(x) * self.docs // self.words for x in n], np.int64)
        return 25 + 75 * n * self.docs // self.words


class Run:
    """Impact-sorted lists of some documents."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, m: np.ndarray, terms_: np.ndarray, tfs: np.ndarray, sizes: np.ndarray):
        self.ids, self.nulls = ids, nulls
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        impact = 10**9 * tfs // (1000 * tfs + 8 * m[doc])  # at most a million
        order = np.argsort((terms_ << 21) - impact, kind="stable")
        self.impact, self.doc = impact[order], doc[order]
        self.starts = np.searchsorted(terms_[order], np.arange(int(terms_.max(initial=-1)) + 2))

    def list_of(self, term: int) -> tuple[int, int]:
        return (int(self.starts[term]), int(self.starts[term + 1])) if term + 1 < len(self.starts) else (0, 0)

    def parts(self, lists: int) -> Iterator[Run]:
        """Runs of fewer documents, so that marks for ``lists`` lists fit."""
        size = max(1, MARKS // max(lists, 1))
        if len(self.ids) <= size:
            yield self
            return
        for a in range(0, len(self.ids), size):
            part = Run.__new__(Run)
            own = (self.doc >= a) & (self.doc < a + size)
            part.ids, part.nulls = self.ids[a:a + size], self.nulls[a:a + size]
            part.impact, part.doc = self.impact[own], self.doc[own] - a
            part.starts = np.concatenate([[0], np.cumsum(own)])[self.starts]
            yield part

    def best(self, query: list[tuple[int, int]], k: int, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best of ``query``, (term, factor) pairs, in
        no order and with ties at the k-th; documents below ``cutoff`` may be missing."""
        lists = [(a, b, factor) for term, factor in query if factor > 0 for a, b in [self.list_of(term)] if a < b]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, seen = np.zeros(len(self.ids), np.int64), np.zeros((len(lists), len(self.ids)), bool)
        known = np.zeros(0, np.int64)  # candidates, once no other document can enter
        slot = None
        read, size = 0, FIRST_BLOCK
        while True:
            ahead = np.zeros(len(lists), np.int64)  # what an unread entry of a list can add at most
            for i, (a, b, factor) in enumerate(lists):
                start, stop = min(a + read, b), min(a + read + size, b)
                docs, gain = self.doc[start:stop], self.impact[start:stop] * factor
                if slot is None:
                    lower[docs] += gain  # a document is in a list once
                    seen[i, docs] = True
                else:
                    at = slot[docs]
                    there = at >= 0
                    lower[at[there]] += gain[there]
                    seen[i, at[there]] = True
                if stop < b:
                    ahead[i] = self.impact[stop] * factor
            read += size
            size *= 2
            least = max(cutoff, 1)
            if len(lower) >= k:
                least = max(least, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            upper = lower + ahead.sum() - ahead @ seen
            open_ = upper >= least  # may belong, ties included
            if slot is None:
                if ahead.sum() < least:  # nor can any document not seen so far
                    known = np.flatnonzero(open_)
                    slot = np.full(len(self.ids), -1, np.int64)
                    slot[known] = np.arange(len(known))
                    lower, upper, seen = lower[known], upper[known], seen[:, known]
            else:  # fewer and fewer
                known, lower, upper, seen = known[open_], lower[open_], upper[open_], seen[:, open_]
                slot[:] = -1
                slot[known] = np.arange(len(known))
            if slot is not None and (lower == upper).all():
                return known, lower


def _runs(batches, corpus: Corpus) -> Iterator[Run]:
    held: list[tuple] = []
    size = 0

    def run() -> Run:
        ids, nulls, n, terms_, tfs, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        return Run(ids, nulls, corpus.lengths(n), terms_, tfs, sizes)

    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            part = batch.slice(start, 1_000)
            ids = part.column("doc_id")
            terms_, tfs = part.column("terms"), part.column("tfs")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                         part.column("n").to_numpy(), terms_.flatten().to_numpy().astype(np.int64),
                         tfs.flatten().to_numpy().astype(np.int64), np.diff(terms_.offsets.to_numpy())))
            size += len(held[-1][3])
            if size >= RUN_POSTINGS:
                yield run()
                held, size = [], 0
    if size:
        yield run()


def _best_rows(rows: DataFrame, queries: list[list[tuple[int, int]]], corpus: Corpus, k: int) -> DataFrame:
    """query (its number), doc_id, score: at least the k best of each query."""
    shipped = rows.sparkSession.sparkContext.broadcast((queries, corpus))

    def run(batches):
        queries, corpus = shipped.value
        none = np.zeros(0, np.int64)
        held = [(none, none, none)] * len(queries)  # score, null id, id: the best of the task so far
        for some in _runs(batches, corpus):
            for q, query in enumerate(queries):
                for part in some.parts(len(query)):
                    score, null, ids = held[q]
                    docs, found = part.best(query, k, int(score[-1]) if len(score) >= k else 0)
                    if len(docs):
                        score, null, ids = (np.concatenate(x) for x in ((score, found), (null, part.nulls[docs].astype(np.int64)), (ids, part.ids[docs])))
                        order = np.lexsort((ids, null, -score))[:k]
                        held[q] = score[order], null[order], ids[order]
        number = np.repeat(np.arange(len(queries)), [len(h[0]) for h in held])
        if len(number):
            score, null, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids, mask=null.astype(bool)), pa.array(score)],
                                             ["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, doc_id bigint, score bigint")


def _blocks(queries: DataFrame) -> Iterator[list]:
    held = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


def search(documents: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every row of ``queries``."""
    spark = documents.sparkSession
    kind = dict(queries.dtypes)[query_id]
    out = fresh_path(spark, "nra-best")
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    asked = queries.select(F.col(query_id).alias("item_id"), F.encode(F.col(query_text).cast("string"), "UTF-8").alias("text")).where("text is not null")
    for block in _blocks(asked):
        texts = [Counter(terms(bytes(r["text"]))) for r in block]
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        if not vocabulary:
            continue
        rows = stored(postings(documents, vocabulary, id_column, text_column), "nra-postings")
        corpus = Corpus(rows)
        weighted = [[(vocabulary[w], c * corpus.weight(vocabulary[w])) for w, c in t.items()] for t in texts]
        best = _best_rows(rows, weighted, corpus, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"query int, item_id {kind}")
        best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def oracle_sql(k: int = 10) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(column: str) -> str:
        return f"regexp_extract_all(translate({column}, '{upper}', '{lower}'), '{term}')"

    return f"""
WITH cut AS (SELECT row_number() OVER () AS row, doc_id, {words('text')} AS words FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row, doc_id, words, len(words) AS n FROM cut WHERE len(words) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM docs),
tfs AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY term),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest({words('text')}) AS term
  FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
scores AS (SELECT item, item_id, row, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""
