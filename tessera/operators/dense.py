"""Dense vectors: exact k-NN (R5, J4), feature-hashing embedder (R7), vector
collection build and idempotent add (R8, S6, K2), LSH candidates (R6).

Exact k-NN never forms the query x corpus pair table: each cell of a grid of
corpus chunks and query blocks keeps only the k best per query, and a per-query
top-k over those partial lists (a partial WindowGroupLimit, then one small
shuffle) gives the exact answer. Distances are rounded before ranking and ties
go to the lower id, so the result does not depend on partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.lexical import counted, sliced, text_rows, token_patterns, tokenized
from tessera.operators.topk import top_k
from tessera.session import materialize

METRICS = ("l2", "cosine", "ip")
MAX_QUERY_BLOCK = 4096
# Queries scored at once inside a cell, and corpus rows of a cell.
STEP, MAX_CHUNK = 64, 50_000


def _distances(X: np.ndarray, Q: np.ndarray, metric: str) -> np.ndarray:
    """[n, nq] distances: squared L2, 1 - cosine similarity, or 1 - inner product."""
    dot = X @ Q.T
    if metric == "l2":
        return np.maximum((X * X).sum(1)[:, None] - 2.0 * dot + (Q * Q).sum(1)[None, :], 0.0)
    if metric == "cosine":
        nx = np.sqrt((X * X).sum(1))[:, None]
        nq = np.sqrt((Q * Q).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where((nx > 0) & (nq > 0), dot / (nx * nq), 0.0)
        return 1.0 - sim
    if metric == "ip":
        return 1.0 - dot
    raise ValueError(metric)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _cell_topk(k: int, metric: str, digits: int, schema: pa.Schema):
    """Exact top-k of one cell (a chunk of the corpus x a block of queries): STEP
    queries at a time, the k-th distance by partition, then only rows up to it sorted."""

    def run(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        if not corpus.num_rows or not queries.num_rows:
            return schema.empty_table()
        order = pc.sort_indices(corpus.column("_id")).to_numpy()
        corpus = corpus.take(order)  # row numbers now order ties by id
        X, Q = _matrix(corpus.column("_v")), _matrix(queries.column("_v"))
        rows, at, dist = [], [], []
        kth = min(k, len(X)) - 1
        for a in range(0, len(Q), STEP):
            D = np.round(_distances(X, Q[a:a + STEP], metric), digits)
            row, q = np.nonzero(D <= np.partition(D, kth, axis=0)[kth])
            d = D[row, q]
            best = np.lexsort((row, d, q))
            starts = np.flatnonzero(np.diff(q[best], prepend=-1))
            place = np.arange(len(best)) - np.repeat(starts, np.diff(starts, append=len(best)))
            best = best[place < k]
            rows.append(row[best])
            at.append(a + q[best])
            dist.append(d[best])
        rows, at, dist = (np.concatenate(x) for x in (rows, at, dist))
        return pa.Table.from_arrays([queries.column("_q").take(pa.array(at)), corpus.column("_id").take(pa.array(rows)), pa.array(dist)],
                                    schema=schema)

    return run


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id",
        vec_col: str = "embedding", qid: str = "query_id", qvec: str = "embedding",
        digits: int = 6, block: int = MAX_QUERY_BLOCK) -> DataFrame:
    """Exact k nearest corpus rows per query: (query_id, id, distance, rank).

    ``MAX_CHUNK`` bounds a chunk. Chunks of the corpus and blocks of queries meet in a grid of cells (an equi-join
    on the cell), so neither side is broadcast or collected; ids keep their types."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = corpus.sparkSession
    c = corpus.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).where("_v is not null")
    q = queries.select(F.col(qid).alias("_q"), F.col(qvec).cast("array<double>").alias("_v")).where("_v is not null")
    # a cell holds MAX_CHUNK rows or so, however large the corpus (the count reads no vector)
    rows = corpus.where(F.col(vec_col).isNotNull()).count()
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // MAX_CHUNK))
    blocks = max(1, -(-q.count() // block))
    c = c.select("*", F.pmod(F.xxhash64("_id"), F.lit(chunks)).alias("_chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    q = q.select("*", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int").alias("_block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("_chunk"))
    out = T.StructType([T.StructField("query_id", q.schema["_q"].dataType), T.StructField(id_col, c.schema["_id"].dataType),
                        T.StructField("distance", T.DoubleType())])
    cell = c.groupBy("_chunk", "_block").cogroup(q.groupBy("_chunk", "_block"))
    partial = cell.applyInArrow(_cell_topk(k, metric, digits, to_arrow_schema(out)), out)
    found = top_k(partial, "query_id", [F.col("distance"), F.col(id_col)], k)
    return found.withColumnRenamed("query_id", qid) if qid != "query_id" else found


def centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group: a partial/final average per (group, position);
    a group's vector holds one value per dimension (bounded)."""
    per_dim = (df.select(group_col, F.posexplode(vec_col).alias("pos", "v"))
               .groupBy(group_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("v")))
    return (per_dim.groupBy(group_col)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_l"))
            .select(group_col, F.transform("_l", lambda x: x["v"]).alias(vec_col)))


# --------------------------------------------------------------------------- embedder


def _hashed(df: DataFrame, id_col: str, text_col: str, dim: int, ngram_max: int) -> DataFrame:
    """(id, idx array, value array): a row's signed feature hashes, L2-normalised, where any is not 0.
    A task holds one slice of whole texts, in which every distinct gram is hashed once."""
    rows, patterns = text_rows(df, id_col, text_col), token_patterns(df.sparkSession)
    out = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("idx", T.ArrayType(T.IntegerType())),
                        T.StructField("value", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)

    def embed(batches):
        for table in sliced(tokenized(batches, patterns), ngram_max):
            ids, terms, term, doc, tf = counted(table, ngram_max)
            own, at = np.unique(term, return_inverse=True)
            digests = [hashlib.md5(t.encode()).digest() for t in terms.take(pa.array(own)).to_pylist()]
            heads = np.frombuffer(b"".join(d[:5] for d in digests), np.uint8).reshape(-1, 5).astype(np.int64)
            idx = (heads[:, :4] @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % dim
            sign = np.where((heads[:, 4] >> 4) % 2 == 0, 1, -1)
            key, place = np.unique(doc * dim + idx[at], return_inverse=True)
            v = np.bincount(place, weights=sign[at] * tf, minlength=len(key))
            key, v = key[v != 0], v[v != 0]
            doc = key // dim
            v = v / np.sqrt(np.bincount(doc, weights=v * v))[doc] if len(v) else v
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            offsets = pa.array(np.append(starts, len(doc)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[starts])), pa.ListArray.from_arrays(offsets, pa.array((key % dim).astype(np.int32))),
                                              pa.ListArray.from_arrays(offsets, pa.array(v))], names=schema.names).cast(schema)

    return rows.mapInArrow(embed, out)


def hash_features(df: DataFrame, id_col: str, text_col: str, dim: int = 64,
                  ngram_max: int = 2) -> DataFrame:
    """Signed feature hashing of the 1- and 2-grams: (id, idx, value), L2-normalised.

    Bucket = first 8 hex digits of md5(gram) mod dim; sign from the 9th hex
    digit's low bit. Sparse long form; ``hash_embed`` builds the array."""
    return _hashed(df, id_col, text_col, dim, ngram_max).select(id_col, F.inline(F.arrays_zip("idx", "value")))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64,
               out: str = "embedding") -> DataFrame:
    """R7 built-in embedder: dense hashed vectors, written once (a search counts its corpus
    before it reads it); rows without grams get none."""
    m = _hashed(df, id_col, text_col, dim, 2).select(id_col, F.map_from_arrays("idx", "value").alias("_m"))
    return materialize(m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias(out)),
                       "hash-vectors")


# --------------------------------------------------------------------------- collection


def collection_rows(df: DataFrame, id_col: str, text_col: str, vec_col: str) -> DataFrame:
    """R8 row shape: (id STRING, text, metadata STRUCT<index BIGINT>, embedding)."""
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                     F.struct(F.col(id_col).cast("long").alias("index")).alias("metadata"),
                     F.col(vec_col).cast("array<float>").alias("embedding"))


def read_collection(spark, path: str) -> DataFrame:
    """Read a collection, or an empty one with the schema when absent."""
    schema = "id string, text string, metadata struct<index:bigint>, embedding array<float>"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def add_to_collection(path: str, rows: DataFrame) -> int:
    """K2 add: rows whose id is already stored are skipped (idempotent append); of
    rows that repeat an id the one with the lowest metadata index is added. One
    writer at a time.

    The anti join reads only the stored ``id`` column; the new rows are
    written as new files, the stored files are never rewritten."""
    spark = rows.sparkSession
    existing = read_collection(spark, path).select("id")
    one = rows.groupBy("id").agg(F.min(F.struct("metadata", "text", "embedding")).alias("r"))
    new = one.join(existing, "id", "left_anti").select("id", "r.text", "r.metadata", "r.embedding")
    obs = Observation("added")
    new.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(obs.get["n"])


def lsh_knn(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id",
            vec_col: str = "embedding", qid: str = "query_id", qvec: str = "embedding",
            bucket_length: float = 1.0, num_tables: int = 8, seed: int = 7, digits: int = 6) -> DataFrame:
    """Approximate k-NN. Random-projection LSH puts vectors into buckets; the
    candidate join is an equi-join on (table, bucket), then candidates are
    re-scored exactly (squared L2) and ranked. Pairs in no shared bucket are missed
    (the approximation; no distance is cut), and a query whose buckets hold fewer
    than k rows goes to the exact search."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    c = corpus.select(F.col(id_col).alias("_id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    q = queries.select(F.col(qid).alias("_q"), array_to_vector(F.col(qvec).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                       numHashTables=num_tables, seed=seed).fit(c)
    pairs = model.approxSimilarityJoin(q, c, float("inf"), distCol="d")
    cand = pairs.select(F.col("datasetA._q").alias(qid), F.col("datasetB._id").alias(id_col),
                        F.round(F.col("d") * F.col("d"), digits).alias("distance"))
    cand = materialize(top_k(cand, qid, [F.col("distance"), F.col(id_col)], k), "lsh-candidates")
    full = cand.where(F.col("rank") == k).select(qid)
    short = queries.join(full, qid, "left_anti")
    exact = knn(corpus, short, k, "l2", id_col, vec_col, qid, qvec, digits)
    return cand.join(full, qid, "left_semi").unionByName(exact.select(*cand.columns))
