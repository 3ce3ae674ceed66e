"""Exact k-NN that leaves rings unread by the triangle inequality.

``build`` takes pivots from a bounded sample (k-means centres), deals every
vector to its nearest pivot and cuts each pivot's rows into rings by their
distance to it (quantiles). A ring knows its least and largest distance, so no
row in it can be nearer to a query than ``max(dq - high, low - dq)``, with dq
the query's distance to the pivot. Rings are stored as Parquet partitions; a
ring of more than ``CHUNK_ROWS`` rows is read in chunks.

``search`` reads the rings nearest by that bound until they hold k rows for a
query, takes the k-th distance found as its radius, and then reads just the
rings whose bound lies within the radius. The result is that of ``dense.knn``;
``rings_read`` tells how many rows and rings were read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.ann import _rows, kmeans
from tessera.operators.dense import MAX_QUERY_BLOCK, _cell_topk
from tessera.operators.topk import top_k
from tessera.session import fits, materialize, work_path

#: Rows of the sample, most pivots, rows of a ring at least, rings of a pivot at most, rows of a chunk.
SAMPLE_ROWS, MOST_PIVOTS, RING_ROWS, MOST_RINGS, CHUNK_ROWS = 20_000, 1_024, 32, 16, 50_000
#: Room for rounding in a comparison of distances.
SLACK = 1e-6


@dataclass
class PivotIndex:
    rows: DataFrame  # cell, ring, chunk, id, embedding (unit vectors' own values stay as they came)
    rings: DataFrame  # cell, ring, low, high, n, chunks
    pivots: np.ndarray
    cosine: bool
    id_col: str

    @staticmethod
    def load(spark: SparkSession, path: str) -> PivotIndex:
        meta = spark.read.parquet(f"{path}/pivots").first()
        rows = spark.read.schema(f"cell int, ring int, chunk int, `{meta['id_col']}` {meta['id_type']}, embedding array<double>").parquet(f"{path}/rows")
        rings = spark.read.schema("cell int, ring int, low double, high double, n bigint, chunks int").parquet(f"{path}/rings")
        return PivotIndex(rows, rings, np.frombuffer(meta["pivots"]).reshape(-1, meta["dim"]), meta["cosine"], meta["id_col"])


def _placed(x: np.ndarray, cosine: bool) -> np.ndarray:
    """Vectors in the space whose Euclidean distance orders them: cosine compares unit vectors."""
    if not cosine:
        return x
    norm = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for a in range(0, len(x), 256):  # differences, not the expanded square: bounds must hold for near rows too
        d = x[a:a + 256, None, :] - pivots[None]
        out[a:a + 256] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def build(vectors: DataFrame, path: str | None = None, id_col: str = "id", vec_col: str = "embedding", metric: str = "l2",
          pivots: int | None = None, seed: int = 7) -> PivotIndex:
    """Write an index of all ``vectors`` (of one length; rows without a vector are left out) to ``path``.
    With ``cosine`` a zero vector has no place in the index and raises."""
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be l2 or cosine")
    spark, cosine = vectors.sparkSession, metric == "cosine"
    path = path or work_path(spark, "pivot-index")
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull())
    n = rows.count()
    if not n:
        raise ValueError("no vector to index")
    below = int(-(1 << 63) + min(1.0, SAMPLE_ROWS / n) * (1 << 64)) - 1
    sample = rows.where(F.xxhash64(id_col) <= min(below, (1 << 63) - 1)).select("embedding").limit(2 * SAMPLE_ROWS).toArrow()
    sample = sample if sample.num_rows else rows.select("embedding").limit(SAMPLE_ROWS).toArrow()
    x = _placed(_rows(sample.column(0).combine_chunks()), cosine)
    x = x[np.lexsort(x.T[::-1])]
    centres = kmeans(x, pivots or int(min(MOST_PIVOTS, max(1, round(n**0.5 / 2)), len(x))), seed)
    shipped = spark.sparkContext.broadcast(centres)  # MOST_PIVOTS vectors

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                v = _placed(_rows(batch.column(1)), cosine)
                if cosine and not (v != 0).any(axis=1).all():
                    raise ValueError("a zero vector has no cosine")
                d = _distances(v, shipped.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), batch.column(0), batch.column(1)],
                                                 ["cell", "d", id_col, "embedding"])

    kind = dict(rows.dtypes)[id_col]
    placed = materialize(rows.mapInArrow(place, f"cell int, d double, `{id_col}` {kind}, embedding array<double>"), "pivot-rows")
    cuts = F.percentile_approx("d", [i / MOST_RINGS for i in range(1, MOST_RINGS)])
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("all"), cuts.alias("cuts"))  # a row a pivot
    rings = F.least(F.lit(MOST_RINGS), F.ceil(F.col("all") / RING_ROWS))
    # a row's ring: how many quantiles lie below it, of as many rings as the cell has
    ring = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("d"))) * rings / MOST_RINGS).cast("int")
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", ring).drop("cuts", "all")
    ringed = materialize(ringed, "pivot-rings")
    ringed.groupBy("cell", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).withColumn(
        "chunks", F.ceil(F.col("n") / CHUNK_ROWS).cast("int")).coalesce(1).write.parquet(f"{path}/rings")  # MOST_PIVOTS x MOST_RINGS rows at most
    chunks = spark.read.parquet(f"{path}/rings").select("cell", "ring", "chunks")
    dealt = ringed.join(F.broadcast(chunks), ["cell", "ring"]).withColumn("chunk", F.pmod(F.xxhash64(id_col), "chunks").cast("int")).drop("chunks", "d")
    dealt.repartition("cell", "ring", "chunk").write.partitionBy("cell", "ring", "chunk").parquet(f"{path}/rows")
    meta = [(centres.shape[1], cosine, id_col, kind, centres.astype(np.float64).tobytes())]
    spark.createDataFrame(meta, "dim int, cosine boolean, id_col string, id_type string, pivots binary").write.parquet(f"{path}/pivots")
    return PivotIndex.load(spark, path)


def _chosen(index: PivotIndex, queries: DataFrame, k: int) -> DataFrame:
    """_q, _v, cell, ring, chunk, first: the rings each query needs. ``queries`` has _q, _v and radius;
    a null radius asks for the rings that hold the first k rows, any other for those within it but these."""
    rings = index.rings.orderBy("cell", "ring").collect()  # MOST_PIVOTS x MOST_RINGS rows at most
    cell, ring, low, high, n, chunks = (np.array([r[c] for r in rings]) for c in ("cell", "ring", "low", "high", "n", "chunks"))
    shipped = queries.sparkSession.sparkContext.broadcast((index.pivots, index.cosine))

    def choose(batches):
        pivots, cosine = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            dq = _distances(_placed(_rows(batch.column(1)), cosine), pivots)[:, cell]
            least = np.maximum(np.maximum(dq - high, low - dq), 0.0)
            order = np.lexsort((np.broadcast_to(np.arange(len(cell)), least.shape), np.abs(dq - (low + high) / 2), least), axis=1)
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(least.shape, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            radius = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            take = np.where(np.isnan(radius), first, ~first & (least <= radius + SLACK))
            q, r = np.nonzero(take)
            times = chunks[r]
            q, r = np.repeat(q, times), np.repeat(r, times)
            chunk = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(q)) for c in (0, 1)), *(pa.array(x, pa.int32()) for x in (cell[r], ring[r], chunk))],
                                             ["_q", "_v", "cell", "ring", "chunk"])

    fields = [queries.schema["_q"], queries.schema["_v"], *(T.StructField(c, T.IntegerType()) for c in ("cell", "ring", "chunk"))]
    return materialize(queries.select("_q", "_v", "radius").mapInArrow(choose, T.StructType(fields)), "pivot-reads")


KEYS = ["cell", "ring", "chunk", "_block"]


def _partial(index: PivotIndex, chosen: DataFrame, k: int, digits: int, qid: str) -> DataFrame:
    """The k best of each query within each chunk it reads."""
    kind, id_col = "cosine" if index.cosine else "l2", index.id_col
    blocks = max(1, -(-chosen.select("_q").distinct().count() // MAX_QUERY_BLOCK))
    q = chosen.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int"))
    need = q.select(*KEYS[:3], F.col("_block").alias("_part")).distinct()
    # partitions that nobody reads are pruned from the scan where the list of the others may be broadcast
    rows = index.rows.join(F.broadcast(need) if fits(chosen) else need, KEYS[:3]).select(*KEYS[:3], "_part", F.col(id_col).alias("_id"), F.col("embedding").alias("_v"))
    out = T.StructType([T.StructField(qid, q.schema["_q"].dataType), T.StructField(id_col, index.rows.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    cell = rows.groupBy(*KEYS[:3], "_part").cogroup(q.groupBy(*KEYS))
    return materialize(cell.applyInArrow(_cell_topk(k, kind, digits, to_arrow_schema(out)), out), "pivot-found")


def search(index: PivotIndex, queries: DataFrame, k: int, qid: str = "query_id", qvec: str = "embedding", digits: int = 6) -> DataFrame:
    """qid, id, distance, rank: the exact k nearest rows of each query, as ``dense.knn``."""
    return _search(index, queries, k, qid, qvec, digits)[0]


def _search(index, queries, k, qid, qvec, digits):
    dim = index.pivots.shape[1]
    q = queries.select(F.col(qid).alias("_q"), F.col(qvec).cast("array<double>").alias("_v")).where(F.size("_v") == dim)
    order = [F.col("distance"), F.col(index.id_col)]
    first = _chosen(index, q.withColumn("radius", F.lit(None).cast("double")), k)
    found = _partial(index, first, k, digits, qid)
    kth = top_k(found, qid, order, k).groupBy(qid).agg(F.max("distance").alias("kth"))
    # a distance is rounded: the radius is that of the largest value that rounds to it
    square = F.greatest(F.col("kth"), F.lit(0.0)) * (2.0 if index.cosine else 1.0) + 2.0 * 10.0**-digits
    near = q.join(kth.select(F.col(qid).alias("_q"), F.sqrt(square).alias("radius")), "_q")
    second = _chosen(index, near, k)
    best = found.unionByName(_partial(index, second, k, digits, qid))
    return top_k(best, qid, order, k), first.unionByName(second)


def rings_read(index: PivotIndex, queries: DataFrame, k: int, qid: str = "query_id", qvec: str = "embedding", digits: int = 6) -> DataFrame:
    """qid, rings, rows, rings_read, rows_read of an exact search."""
    reads = _search(index, queries, k, qid, qvec, digits)[1].select(F.col("_q").alias(qid), "cell", "ring").distinct()
    every = index.rings.agg(F.count(F.lit(1)).alias("rings"), F.sum("n").alias("rows"))  # one row
    counted = reads.join(F.broadcast(index.rings.select("cell", "ring", "n")), ["cell", "ring"]).groupBy(qid).agg(
        F.count(F.lit(1)).alias("rings_read"), F.sum("n").alias("rows_read"))
    return counted.crossJoin(F.broadcast(every)).select(qid, "rings", "rows", "rings_read", "rows_read")
