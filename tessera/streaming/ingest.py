"""Stateful ingest (ST2): repeats of a key go, whatever the batches.

One rule, in event time: a row is kept if no row of its key was kept within
``delay`` before it (rows of one time: the smallest by their columns comes
first). Rows wait in the state store until the watermark (the latest time seen
less ``lateness``) has passed them, so all rows before them have arrived, and
the result depends neither on how files fall into batches nor on the order of
rows in them. Only a row that comes more than ``lateness`` late can't be placed
any more; such rows are kept in ``late`` beside the sink, none is lost.

Keys are dealt into ``BUCKETS`` buckets, so a batch calls the rule once a bucket
and not once a key. A bucket's state is the last kept times of its keys, as long
as they matter, and its waiting rows, which span at most ``lateness``; rows that
share key and time wait as one. The state and the sink live in the shared folder:
the same ``sink`` continues where it stopped, and a replayed batch overwrites its
own folder."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Buckets of keys (a checkpoint's state is made for this number).
BUCKETS = 512
#: A bucket's state: last kept times (microseconds) of its keys and its waiting rows, as Arrow streams.
STATE = "kept binary, waiting binary"
KEPT = pa.schema([("_key", pa.string()), ("_at", pa.int64())])
WAITING = KEPT.append(pa.field("_row", pa.string()))
#: Rows keep the microseconds of their times.
FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _ms(interval: str, spark: SparkSession) -> int:
    return spark.sql(f"SELECT cast((timestamp '1970-01-02' + INTERVAL {interval} - timestamp '1970-01-02') as interval second) AS i").select(
        (F.col("i").cast("decimal(20, 3)") * 1000).cast("bigint")).first()[0]


def settle(kept: int, waiting: list, until: int, delay: int) -> tuple[list, int, list]:
    """(rows kept, last kept time, rows still waiting) when all times below ``until`` are final."""
    out, rest = [], []
    for at, row in sorted(waiting):
        if at >= until:
            rest.append([at, row])
        elif kept < 0 or at - kept > delay:
            out.append(row)
            kept = at
    return out, kept, rest


def _merged(waiting: list, rows: list) -> list:
    """Waiting rows, one for each time (the smallest: no other of that time can be kept)."""
    first: dict[int, str] = dict(map(tuple, waiting))
    for at, row in rows:
        if at not in first or row < first[at]:
            first[at] = row
    return [[at, row] for at, row in sorted(first.items())]


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()


def merged(rows: pa.Table) -> pa.Table:
    """The rows of a bucket by key and time, one for each (``_merged`` for all keys at once)."""
    rows = rows.sort_by([(name, "ascending") for name in ("_key", "_at", "_row")]).combine_chunks()
    key, at = rows.column("_key").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("_at").to_numpy()
    first = np.ones(len(at), bool)
    first[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return rows.filter(pa.array(first))


def settled(kept: pa.Table, waiting: pa.Table, until: int, delay: int) -> tuple[list, pa.Table, pa.Table]:
    """``settle`` for all keys of a bucket; kept times that no later row can meet go."""
    last = dict(zip(kept.column("_key").to_pylist(), kept.column("_at").to_pylist(), strict=True))
    final = waiting.column("_at").to_numpy() < until
    rows, out = waiting.filter(pa.array(final)), []
    each = zip(*(rows.column(c).to_pylist() for c in ("_key", "_at", "_row")), strict=True)
    for key, own in groupby(each, lambda r: r[0]):
        found, last[key], _ = settle(last.get(key, -1), [[at, row] for _, at, row in own], until, delay)
        out += found
    last = {key: at for key, at in last.items() if until <= at + delay}
    return out, pa.table([pa.array(last.keys(), pa.string()), pa.array(last.values(), pa.int64())], schema=KEPT), waiting.filter(pa.array(~final))


def dedupe(stream: DataFrame, key: str, ts: str, delay: str, lateness: str) -> DataFrame:
    """The kept rows of a stream, as they become final, and late ones: the stream's columns and
    ``is_late``. ``ts`` must be a timestamp after 1970; rows without a key or a time are passed on as kept."""
    spark = stream.sparkSession
    delay_us = 1_000 * _ms(delay, spark)
    columns = stream.columns
    # Spark drops late rows unseen by the time they carry: the marked column that a stateful operator
    # must have is empty here (an empty time is never late), and the operator compares _at itself
    mark = F.lit(None).cast("timestamp").alias("_mark", metadata={"spark.watermarkDelayMs": _ms(lateness, spark)})
    packed = stream.withWatermark(ts, lateness).select(
        F.col(key).cast("string").alias("_key"), mark, F.unix_micros(ts).alias("_at"), F.to_json(F.struct(*columns), {**FORMAT, "ignoreNullFields": "false"}).alias("_row"))
    packed = packed.withColumn("_bucket", F.pmod(F.xxhash64(F.coalesce("_key", "_row")), F.lit(BUCKETS)).cast("int"))
    out = T.StructType([T.StructField("_row", T.StringType()), T.StructField("is_late", T.BooleanType())])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, held = map(_unpack, state.get) if state.exists else (KEPT.empty_table(), WAITING.empty_table())
        mark = 1_000 * state.getCurrentWatermarkMs()
        parts, late = [held], []
        for frame in frames:
            free = frame["_key"].isna() | frame["_at"].isna()
            if free.any():
                yield pd.DataFrame({"_row": frame.loc[free, "_row"], "is_late": False})
            rows = frame.loc[~free, WAITING.names].astype({"_at": "int64"})
            now = rows["_at"] < mark
            late += rows.loc[now, "_row"].tolist()
            parts.append(pa.Table.from_pandas(rows.loc[~now], WAITING, preserve_index=False))
        out_rows, kept, waiting = settled(kept, merged(pa.concat_tables(parts)), mark, delay_us)
        state.update((_pack(kept), _pack(waiting)))
        # the next time that matters: the first waiting row's, or when a kept time doesn't any more
        ends = [(at + more) // 1_000 + 1 for times, more in ((waiting, 0), (kept, delay_us)) if times.num_rows
                for at in [int(times.column("_at").to_numpy().min())]]
        if ends:
            state.setTimeoutTimestamp(min(ends))
        else:
            state.remove()
        yield pd.DataFrame({"_row": out_rows + late, "is_late": [False] * len(out_rows) + [True] * len(late)})

    found = packed.groupBy("_bucket").applyInPandasWithState(step, out, T._parse_datatype_string(STATE), "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("_row", stream.schema, FORMAT).alias("r"), "is_late").select("r.*", "is_late")


def run(stream: DataFrame, sink: str, key: str, ts: str, delay: str = "1 hour", lateness: str = "1 day") -> None:
    """Ingest what has landed (availableNow) into ``sink/batches``; rows that still wait stay in the state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("is_late").parquet(f"{sink}/batches/batch_id={batch_id}")

    query = (dedupe(stream, key, ts, delay, lateness).writeStream.foreachBatch(write)
             .option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def _batches(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    fields = [*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("is_late", T.BooleanType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{sink}/batches").drop("batch_id")


def waiting_rows(spark: SparkSession, sink: str, schema: T.StructType, delay: str = "1 hour") -> DataFrame:
    """What the rule keeps of the rows that still wait, as if nothing else came: read from the
    state store, which stays as it is."""
    delay_us = 1_000 * _ms(delay, spark)
    state = spark.read.format("statestore").load(f"{sink}/checkpoint")
    values = state.select(F.col("value.groupState.kept").alias("kept"), F.col("value.groupState.waiting").alias("waiting"))

    def finish(batches):
        for batch in batches:
            for kept, waiting in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = settled(_unpack(kept), _unpack(waiting), 1 << 62, delay_us)[0]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["_row"])

    return values.mapInArrow(finish, "_row string").select(F.from_json("_row", schema, FORMAT).alias("r")).select("r.*")


def ingested(spark: SparkSession, sink: str, schema: T.StructType, delay: str = "1 hour") -> DataFrame:
    """All rows the rule keeps so far: the sink's and those of the state that still wait."""
    return _batches(spark, sink, schema).where(~F.col("is_late")).drop("is_late").unionByName(waiting_rows(spark, sink, schema, delay))


def late(spark: SparkSession, sink: str, schema: T.StructType) -> DataFrame:
    """Rows that came after their time was final."""
    return _batches(spark, sink, schema).where("is_late").drop("is_late")
