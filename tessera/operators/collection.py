"""Vector collections as bucketed tables.

A collection is a Parquet table clustered by id into a fixed number of buckets.
Adding rows is an anti-join of the new ids with the stored ones; because the
stored side is already dealt by id, only the new rows are shuffled, however
large the collection has grown. The table's files lie under a path of the
shared storage; a new session registers them again (``open_collection``).

Ids are unique: rows whose id is stored are skipped, and of new rows that repeat
an id the one with the lowest metadata index is added. One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id STRING, text STRING, metadata STRUCT<index: BIGINT>, embedding ARRAY<FLOAT>"


def open_collection(spark: SparkSession, path: str, buckets: int | None = None, recreate: bool = False) -> str:
    """The name under which the collection at ``path`` is registered in this session.

    A collection that doesn't exist is created with ``buckets`` (default: the session's shuffle
    partitions); ``recreate`` drops what is there first. An existing one keeps its buckets."""
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    meta = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets")
    fs = jpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if recreate:
        fs.delete(jpath.getParent(), True)
    if fs.exists(meta):
        buckets = spark.read.json(f"{path}/buckets").first()["buckets"]
    else:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/buckets")
    name = f"collection_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{path}/rows'")
    return name


def new_rows(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    """The rows that ``add`` appends: one of each id that isn't stored. The stored side is read in its buckets."""
    one = rows.groupBy("id").agg(F.min(F.struct("metadata", "text", "embedding")).alias("r"))
    stored = spark.table(name).select("id").hint("merge")  # never collected into a broadcast, whatever its size
    return one.join(stored, "id", "left_anti").select("id", "r.text", "r.metadata", "r.embedding")


def add(spark: SparkSession, name: str, rows: DataFrame) -> int:
    """Append the rows of new ids; returns how many."""
    seen = Observation("added")
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect() if r["col_name"] == "Num Buckets"))
    # a bucket is written by one task, so an add makes one file a bucket at most
    new_rows(spark, name, rows).observe(seen, F.count(F.lit(1)).alias("n")).repartition(buckets, "id").write.insertInto(name)
    return int(seen.get["n"])
