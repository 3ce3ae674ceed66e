"""Incremental TF-IDF index (R3, R8): immutable segments, tombstones, merge at search.

Every change is a numbered step in the shared folder: ``add`` tokenises the new
documents once and writes their term counts in slices; it and ``delete`` write
tombstones, so a document that is added again replaces its old version. Nothing
written is changed. A step counts once its log entry is there, which is written
last, so a step that failed half way is ignored.

``index`` merges: the slices of all steps are the blocks of one index. Only
slices with a document that is gone are counted again without it (from their
lists), those without a document left aren't read; frequencies, N, weights and
norms follow as in a fit, so a search gives the rows of a full refit without
reading or tokenising any text again. ``compact`` writes the live documents as
one segment of a new folder. One writer at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.lexical import BLOCK_SCHEMA, TfidfIndex, index_of_blocks, slice_rows, streams, token_patterns, without
from tessera.session import dealt_parts, fits, materialize

#: A slice's number has so many bits within its step.
SLICE_BITS = 50


def _bits(rows: pa.Table) -> pa.Table:
    """The dead documents of a slice as a bit each, and whether they are all that it has."""
    mask = np.zeros(rows.column("n")[0].as_py(), bool)
    mask[rows.column("doc").to_numpy()] = True
    return pa.table({"slice": rows.column("slice").slice(0, 1), "dead": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary()),
                     "whole": pa.array([bool(mask.all())])})


@dataclass
class SegmentedIndex:
    spark: SparkSession
    path: str
    id_col: str = "doc_id"
    id_type: str = "bigint"
    ngram_max: int = 2

    # --- tables -------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath)

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the finished steps."""
        schema = f"{schema}, step int"
        if not self._exists(name) or not self._exists("log"):
            return self.spark.createDataFrame([], schema)
        done = [r["step"] for r in self.spark.read.json(f"{self.path}/log", schema="step int").collect()]  # one row a step
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("step").isin(done))

    def _slices(self) -> DataFrame:
        """The slices of the finished steps, numbered over all steps."""
        rows = self._read("slices", BLOCK_SCHEMA)
        return rows.withColumn("slice", F.shiftleft(F.col("step").cast("bigint"), SLICE_BITS) + F.col("slice"))

    def _documents(self, slices: DataFrame) -> DataFrame:
        """slice, step, n (documents of the slice), id, doc (its number there)."""
        rows = slices.where("ids is not null").select("slice", "step", "ids")
        out = T.StructType([*rows.schema.fields[:2], T.StructField("n", T.IntegerType()),
                            *T._parse_datatype_string(f"`{self.id_col}` {self.id_type}, doc int").fields])
        schema = to_arrow_schema(out)

        def run(batches):
            for batch in batches:
                for i, docs in enumerate(streams(batch.column("ids"))):
                    n = docs.num_rows
                    same = [pa.array([batch.column(c)[i].as_py()] * n, schema.field(c).type) for c in ("slice", "step")]
                    each = [*same, pa.array([n] * n, pa.int32()), docs.column("id").combine_chunks(), pa.array(np.arange(n, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(each, names=schema.names).cast(schema)

        return rows.mapInArrow(run, out)

    def _write(self, df: DataFrame, name: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/step={step}")

    def _next(self) -> int:
        if not self._exists("log"):
            return 0
        return self.spark.read.json(f"{self.path}/log", schema="step int").agg(F.max("step")).first()[0] + 1

    def _finish(self, step: int) -> None:
        self.spark.createDataFrame([(step,)], "step int").coalesce(1).write.mode("append").json(f"{self.path}/log")

    def live(self) -> DataFrame:
        """The slices (as ``slice_rows``) of the documents that are there."""
        slices = self._slices()
        gone = self._read("deleted", f"`{self.id_col}` {self.id_type}").groupBy(self.id_col).agg(F.max("step").alias("_gone"))
        # a document is one version: of those added, the ones before its last tombstone are gone
        dead = self._documents(slices).join(gone, self.id_col).where(F.col("step") < F.col("_gone")).select("slice", "n", "doc")
        dead = materialize(dead.groupBy("slice").applyInArrow(_bits, "slice bigint, dead binary, whole boolean"), "segment-dead")
        hint = F.broadcast if fits(dead) else (lambda df: df)  # a bit a document, a row a slice
        rows = slices.drop("step").join(hint(dead), "slice", "left")
        untouched = rows.where("dead is null").drop("dead", "whole")
        return untouched.unionByName(without(rows.where("dead is not null and not whole").drop("whole")))

    # --- changes -------------------------------------------------------------------

    def _tombstones(self, ids: DataFrame, step: int) -> None:
        self._write(ids.select(self.id_col).where(F.col(self.id_col).isNotNull()).distinct(), "deleted", step)

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Add documents (null texts and null ids are left out; of rows that repeat an id the smallest
        text counts); those that are there already are replaced."""
        step = self._next()
        docs = docs.select(F.col(self.id_col).cast(self.id_type).alias(self.id_col), F.col(text_col).alias("text")).where(
            F.col(text_col).isNotNull() & F.col(self.id_col).isNotNull())
        # dealt once: the groups and the slices both find their rows where this shuffle put them
        one = docs.repartition(dealt_parts(self.spark), self.id_col).groupBy(self.id_col).agg(F.min("text").alias("text"))
        rows = one.sortWithinPartitions(self.id_col).select(self.id_col, F.lower("text").alias("_t"))
        self._write(slice_rows(rows, self.ngram_max, token_patterns(self.spark)), "slices", step)
        own = self.spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.path}/slices/step={step}")
        self._tombstones(self._documents(own.withColumn("step", F.lit(step))), step)
        self._finish(step)

    def delete(self, ids: DataFrame) -> None:
        """Delete documents by id; unknown ids don't matter."""
        step = self._next()
        self._tombstones(ids.select(F.col(self.id_col).cast(self.id_type).alias(self.id_col)), step)
        self._finish(step)

    # --- use -----------------------------------------------------------------------

    def frequencies(self) -> DataFrame:
        """term, df, cf over the live documents."""
        return self.index(persist=False).vocab.select("term", "df", "cf")

    def index(self, persist: bool = True) -> TfidfIndex:
        """The merged index, as a full fit over the live documents would give it."""
        return index_of_blocks(self.live(), self.id_col, T._parse_datatype_string(self.id_type), self.ngram_max, persist)

    def compact(self, path: str) -> SegmentedIndex:
        """The same documents as one segment in a new folder."""
        new = SegmentedIndex(self.spark, path, self.id_col, self.id_type, self.ngram_max)
        live = self.live()
        numbers = materialize(live.where("ids is not null").select("slice", F.monotonically_increasing_id().alias("_n")), "segment-numbers")
        rows = live.join(F.broadcast(numbers) if fits(numbers) else numbers, "slice")
        new._write(rows.withColumn("slice", F.col("_n")).drop("_n"), "slices", 0)
        new._finish(0)
        return new
