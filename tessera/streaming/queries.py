"""Structured Streaming re-aim of the query path (ST1); the ingest (ST2) is in ``ingest``.

ST1: a stream of queries is answered micro-batch by micro-batch against a
static TF-IDF index (fitted once, written to the shared folder); ranking runs
inside ``foreachBatch`` because row_number is not allowed on a stream.

Sources are tables (a file or a folder of part files). It writes batch folders
that a replayed batch overwrites, with the query's checkpoint beside them: the
same ``run`` name continues where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import guard, lexical
from tessera.plans import pipelines
from tessera.session import materialize, work_path


def _batch_writer(path: str, fn):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Idempotent per batch: a replayed batch rewrites only its own folder.
        fn(batch, path, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def _source(spark: SparkSession, table: str, max_files: int) -> DataFrame:
    """File-source stream over the files of a table (a folder of part files, or one file)."""
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", max_files)
    path, fs = _hadoop(spark, table)
    if fs.getFileStatus(path).isFile():  # a file source watches a folder
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(table)


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _run(stream: DataFrame, sink: str, fn) -> str:
    """Drain the source (availableNow) into ``sink/batches``; returns that path."""
    batches = f"{sink}/batches"
    q = (stream.writeStream.foreachBatch(_batch_writer(batches, fn))
         .option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return batches


def stream_topk(spark: SparkSession, table: str, index: lexical.TfidfIndex, k: int, sink: str | None = None,
                qid: str = "item_id", qtext: str = "text", max_files: int = 1, prepare=None) -> str:
    """ST1: answer a stream of queries; returns the sink path. ``prepare`` turns a batch
    of (query_id, query) into the queries to search (gate, structuring)."""
    src = _source(spark, table, max_files).select(F.col(qid).alias("query_id"), F.col(qtext).alias("query"))

    def answer(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
        q = prepare(batch) if prepare else batch
        return lexical.search(index, q, k).select("query_id", index.id_col, "score", "rank")
    return _run(src, sink or work_path(spark, "stream-topk"), answer)


def stream_courses(spark: SparkSession, table: str, docs: DataFrame, index: lexical.TfidfIndex, k: int, as_queries,
                   sink: str | None = None, max_files: int = 1) -> str:
    """ST1, the whole query path: each batch goes through the input guard, is structured and
    enhanced, searched, and post-filtered, as ``course_retrieve`` does for a table; a blocked
    query gets one row with its reason. ``as_queries`` turns a batch into (query_id, query)."""
    def answer(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
        # a replayed batch may read its files anew, so the verdict is written once
        checked = materialize(guard.verdict(as_queries(batch), guard.input_scanners(F.col("query"))).drop("guard_results"), "stream-checked")
        hits = pipelines.course_retrieve(docs, checked.where("guard_valid").select("query_id", "query"), k, index)
        blocked = checked.where(~F.col("guard_valid")).select("query_id", F.col("guard_reason").alias("reason"))
        return hits.select("query_id", index.id_col, "score", "rank", F.lit(None).cast("string").alias("reason")).unionByName(
            blocked, allowMissingColumns=True)
    return _run(_source(spark, table, max_files), sink or work_path(spark, "stream-courses"), answer)
