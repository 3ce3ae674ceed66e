"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are scaled to integers; a score is the sum of partial scores over
``LISTS`` groups of components, each group being one score list.

1. Every corpus chunk gives, for each query and list, its ``k`` best partial
   scores; their exact scores are gathered, and the k-th best of a query is a
   safe cutoff: its true k-th score is no lower.
2. The cutoff goes back out with the queries. A vector that reaches it has a
   partial score of at least cutoff / LISTS in some list, so each chunk collects
   the entries at or above that uniform threshold and drops those whose upper
   bound (the threshold standing in for lists that didn't report) is lower.
3. What remains is scored exactly, and the best k are kept, first by chunk,
   then by query (ties to the smaller id).

Queries and corpus meet in a grid of chunks and query blocks: each cell is one
bounded group, so neither side is broadcast or gathered, and a lost cell is
computed again alone.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; rows that repeat an id and its vector
count once; rows with the query's id are never its candidates; only vectors
of the same length are compared; fewer than k candidates give fewer rows.
Scores beyond 64 bits wrap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrices, pack_ints, unpack_ints

#: Component groups whose partial scores are the lists.
LISTS = 2
#: A corpus chunk has N / CHUNKS vectors within these bounds; a query block so many queries.
CHUNKS, CHUNK_LEAST, CHUNK_MOST, QUERY_BLOCK = 64, 256, 16_384, 2_048
#: Queries scored against a chunk at once inside a task.
STEP = 128


def quantise(vectors: DataFrame, scale: float, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, dim, packed: floor(scale * x) of every valid vector, once each."""

    def pack(batches):
        for batch in batches:
            for rows, m in matrices(batch.column("vec")):
                ints = np.floor(scale * m).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), m.shape[1], np.int32)),
                     pa.array(pack_ints(ints), pa.binary())], ["vec_id", "dim", "packed"])

    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vec"))
    return (rows.where("vec_id is not null").mapInArrow(pack, "vec_id bigint, dim int, packed binary")
            .dropDuplicates(["vec_id", "dim", "packed"]))


def _matrix(t: pa.Table, dim: int, exact_floats: bool) -> np.ndarray:
    m = unpack_ints(t.column("packed").to_pylist(), dim)
    return m.astype(np.float64) if exact_floats else m


def _cell(corpus: pa.Table, queries: pa.Table, dim: int):
    """Both sides as matrices: float64 if every score is exact in it (fast), else int64."""
    v, q = _matrix(corpus, dim, False), _matrix(queries, dim, False)
    top = [float(np.abs(x).max(initial=0)) for x in (v, q)]
    if dim * top[0] * top[1] < 2.0**53:
        return v.astype(np.float64), q.astype(np.float64)
    return v, q


def _bounds(dim: int) -> list[slice]:
    ends = np.linspace(0, dim, min(LISTS, max(dim, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _best(qi: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best (score falling, id rising)."""
    order = np.lexsort((ids, -score, qi))
    starts = np.flatnonzero(np.diff(qi[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[place < k]


def _rows(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query": pa.array(query.astype(np.int64)), "vec_id": pa.array(ids.astype(np.int64)),
                     "score": pa.array(score.astype(np.int64))})


def _local_lists(k: int):
    """Phase 1 in a cell: exact scores of the k best of every list."""

    def run(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        if not corpus.num_rows or not queries.num_rows:
            return _rows(*[np.zeros(0, np.int64)] * 3)
        dim = corpus.column("dim")[0].as_py()
        v, q = _cell(corpus, queries, dim)
        ids, qids, qn = (t.column(c).to_numpy() for t, c in ((corpus, "vec_id"), (queries, "vec_id"), (queries, "query")))
        out = []
        for a in range(0, len(q), STEP):
            some, own = q[a:a + STEP], ids[None, :] == qids[a:a + STEP, None]
            hit = np.zeros(own.shape, bool)
            partial = [some[:, s] @ v[:, s].T for s in _bounds(dim)]
            for p in partial:
                masked = np.where(own, np.iinfo(np.int64).min if p.dtype == np.int64 else -np.inf, p)
                n = min(k, len(ids))
                top = np.argpartition(-masked if p.dtype != np.int64 else ~masked, n - 1, axis=1)[:, :n]
                np.put_along_axis(hit, top, True, axis=1)
            qi, vi = np.nonzero(hit & ~own)
            score = sum(p[qi, vi] for p in partial)
            keep = _best(qi, score, ids[vi], k)
            out.append(_rows(qn[a + qi[keep]], ids[vi[keep]], score[keep]))
        return pa.concat_tables(out)

    return run


def _above_cutoff(k: int):
    """Phases 2 and 3 in a cell: entries at the uniform threshold, pruned by bound, scored exactly."""

    def run(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        if not corpus.num_rows or not queries.num_rows:
            return _rows(*[np.zeros(0, np.int64)] * 3)
        dim = corpus.column("dim")[0].as_py()
        v, q = _cell(corpus, queries, dim)
        ids, qids, qn = (t.column(c).to_numpy() for t, c in ((corpus, "vec_id"), (queries, "vec_id"), (queries, "query")))
        cutoff = queries.column("cutoff").to_numpy()
        groups, out = _bounds(dim), []
        for a in range(0, len(q), STEP):
            some, own = q[a:a + STEP], ids[None, :] == qids[a:a + STEP, None]
            need = cutoff[a:a + STEP, None]
            share = need.astype(np.float64) / len(groups) - 1e-6  # an entry on the threshold stays in
            seen, upper, partial = np.zeros(own.shape, bool), np.zeros(own.shape), []
            for s in groups:
                p = some[:, s] @ v[:, s].T
                reported = p >= share
                seen |= reported
                upper += np.where(reported, p, share)
                partial.append(p)
            qi, vi = np.nonzero(seen & (upper >= need - 1) & ~own)
            score = sum(p[qi, vi] for p in partial)
            good = score >= cutoff[a + qi]
            qi, vi, score = qi[good], vi[good], score[good]
            keep = _best(qi, score, ids[vi], k)
            out.append(_rows(qn[a + qi[keep]], ids[vi[keep]], score[keep]))
        return pa.concat_tables(out)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``vectors`` that ``is_query``
    (a condition on ``vec_id``) selects, against all other rows."""
    packed = stored(quantise(vectors, scale, id_column, vector_column), "topk-vectors")
    n = packed.count()
    chunks = max(1, -(-n // min(max(n // CHUNKS, CHUNK_LEAST), CHUNK_MOST)))
    queries = packed.where(is_query).withColumn("query", F.monotonically_increasing_id())
    queries = stored(queries, "topk-queries")  # a query's number is fixed from here on
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spread = F.pmod(F.xxhash64("vec_id", "packed"), F.lit(chunks))
    corpus = packed.select("vec_id", "dim", "packed", spread.cast("int").alias("chunk"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    grid = queries.select("query", "vec_id", "dim", "packed", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    cell, shape = ["dim", "block", "chunk"], "query bigint, vec_id bigint, score bigint"
    lists = corpus.groupBy(*cell).cogroup(grid.groupBy(*cell)).applyInArrow(_local_lists(k), shape)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    gathered = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoffs = gathered.where(F.col("rank") == k).select("query", F.col("score").alias("cutoff"))
    # a query with fewer than k candidates has no cutoff: everything passes
    cutoffs = stored(cutoffs, "topk-cutoffs")
    lowest = F.lit(-(1 << 63) + 1).cast("bigint")
    armed = grid.join(cutoffs, "query", "left").withColumn("cutoff", F.coalesce("cutoff", lowest))
    scored = corpus.groupBy(*cell).cogroup(armed.groupBy(*cell)).applyInArrow(_above_cutoff(k), shape)
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = queries.select("query", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(every: int = 50, k: int = 5, scale: float = 256.0) -> str:
    return f"""
WITH e AS (
  SELECT DISTINCT vec_id, [floor({scale} * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {every} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= {k}"""
