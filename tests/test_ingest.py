"""The stateful ingest against its rule, whatever the batches."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.session import work_path
from tessera.streaming import ingest

HOUR = 3_600
SCHEMA = "key string, ts timestamp, v bigint"


def rule(rows, delay=HOUR):
    out, last = [], {}
    for key, at, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] > delay:
            out.append((key, at, v))
            last[key] = at
    return sorted(out, key=repr)


def land(spark, path, rows, files):
    df = spark.createDataFrame(rows, "key string, t bigint, v bigint")
    df = df.select("key", F.timestamp_seconds("t").alias("ts"), "v")
    df.repartition(files).write.mode("append").parquet(path)


def stream(spark, path, files):
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path), schema


def result(spark, sink, schema):
    got = ingest.ingested(spark, sink, schema).select("key", F.col("ts").cast("bigint").alias("t"), "v")
    return sorted(map(tuple, got.collect()), key=repr)


def events(seed, n=160, span=20):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(6)}", 1_700_000_000 + rng.randrange(span * HOUR), i) for i in range(n)]


@pytest.mark.parametrize("files", [1, 100])
def test_result_is_independent_of_batches(spark, files):
    rows = events(1) + [("k9", 1_700_000_000 + m * 60, 1_000 + m) for m in (0, 50, 100)]  # a chain: 0 and 100 stay
    path, sink = work_path(spark, "landed"), work_path(spark, "sink")
    land(spark, path, rows, 7)
    source, schema = stream(spark, path, files)
    ingest.run(source, sink, "key", "ts", lateness="2 days")
    assert result(spark, sink, schema) == rule(rows)
    assert ingest.late(spark, sink, schema).count() == 0


def test_restart_continues_and_rows_settle(spark):
    rows = sorted(events(2, 200, 200), key=lambda r: r[1])
    path, sink = work_path(spark, "landed"), work_path(spark, "sink")
    for a in range(0, 200, 50):  # a run for each landing, as after a restart
        land(spark, path, rows[a:a + 50], 2)
        source, schema = stream(spark, path, 1)
        ingest.run(source, sink, "key", "ts", lateness="60 hours")
        assert result(spark, sink, schema) == rule(rows[:a + 50])
    settled = ingest._batches(spark, sink, schema).count()
    assert 0 < settled < len(rule(rows))  # most are final, the last ones wait
    ingest.run(source, sink, "key", "ts", lateness="60 hours")  # nothing new: nothing changes
    assert result(spark, sink, schema) == rule(rows)


def test_late_rows_are_kept_apart_and_nothing_is_lost(spark):
    path, sink = work_path(spark, "landed"), work_path(spark, "sink")
    first = [("a", 1_700_000_000, 1), ("b", 1_700_000_000 + 100 * HOUR, 2), (None, 1_700_000_000, 3)]
    land(spark, path, first, 1)
    source, schema = stream(spark, path, 1)
    ingest.run(source, sink, "key", "ts", lateness="1 hour")
    land(spark, path, [("a", 1_700_000_000 + 10 * HOUR, 4), ("b", 1_700_000_000 + 100 * HOUR, 2), ("c", 1_700_000_000 + 100 * HOUR, 5)], 1)
    ingest.run(source, sink, "key", "ts", lateness="1 hour")
    assert [r.v for r in ingest.late(spark, sink, schema).collect()] == [4]
    assert sorted(r[2] for r in result(spark, sink, schema)) == [1, 2, 3, 5]


def test_settle():
    assert ingest.settle(-1, [[0, "a"], [50, "b"], [100, "c"], [200, "d"]], 150, 60) == (["a", "c"], 100, [[200, "d"]])
    assert ingest._merged([[5, "b"]], [(5, "a"), (7, "c")]) == [[5, "a"], [7, "c"]]


def test_buckets_follow_the_rule():
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(9)}", rng.randrange(400), rng.choice("ab")) for _ in range(300)]
    table = ingest.merged(pa.Table.from_pylist([dict(zip(ingest.WAITING.names, r, strict=True)) for r in rows], ingest.WAITING))
    out, kept, rest = ingest.settled(ingest.KEPT.empty_table(), table, 250, 60)
    last = dict(zip(*kept.to_pydict().values(), strict=True))
    want, left = [], []
    for key in sorted({r[0] for r in rows}):
        own, at, waiting = ingest.settle(-1, ingest._merged([], [r[1:] for r in rows if r[0] == key]), 250, 60)
        want += own
        left += [(key, *w) for w in waiting]
        assert last.get(key, -1) == (at if at + 60 >= 250 else -1)
    assert out == want and list(zip(*rest.to_pydict().values(), strict=True)) == left


def test_many_keys_take_one_call_a_bucket(spark):
    """The rule is called once a bucket, and a bucket's state is one row, however many keys there are."""
    rows = [(f"k{i}" if i % 50 else None, 1_700_000_000 + i, i) for i in range(3_000)]
    path, sink = work_path(spark, "landed"), work_path(spark, "sink")
    land(spark, path, rows, 2)
    source, schema = stream(spark, path, 1)
    ingest.run(source, sink, "key", "ts", lateness="1 day")
    assert result(spark, sink, schema) == sorted(rows, key=repr)
    assert spark.read.format("statestore").load(f"{sink}/checkpoint").count() <= ingest.BUCKETS
