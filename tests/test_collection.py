"""Bucketed collections: adds, plans, sessions."""

from tessera.operators import collection
from tessera.session import work_path

ROWS = "id string, text string, metadata struct<index: bigint>, embedding array<float>"


def rows(spark, ids, index=0):
    return spark.createDataFrame([(i, f"text {i}", (index,), [1.0, 2.0]) for i in ids], ROWS)


def test_adds_are_idempotent_and_recreate_drops(spark):
    path = work_path(spark, "collection")
    name = collection.open_collection(spark, path, buckets=4)
    assert collection.add(spark, name, rows(spark, ["a", "b", "a"])) == 2
    assert collection.add(spark, name, rows(spark, ["a", "b", "c"], 1)) == 1
    again = collection.open_collection(spark, path)  # as another session would
    assert collection.add(spark, again, rows(spark, ["c", "d"])) == 1
    assert {r.id: r.metadata["index"] for r in spark.table(again).collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}
    assert collection.add(spark, again, rows(spark, [])) == 0
    fresh = collection.open_collection(spark, path, recreate=True)
    assert spark.table(fresh).count() == 0 and collection.add(spark, fresh, rows(spark, ["z"])) == 1


def test_stored_ids_are_not_shuffled(spark):
    name = collection.open_collection(spark, work_path(spark, "collection"), buckets=8)
    collection.add(spark, name, rows(spark, [f"i{i}" for i in range(200)]))
    plan = collection.new_rows(spark, name, rows(spark, [f"i{i}" for i in range(150, 250)]))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    indent = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    k = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "SelectedBucketsCount: 8 out of 8" in x)
    above = []  # the operators between the stored scan and the join
    for i in range(k - 1, -1, -1):
        if indent[i] < indent[k]:
            above.append(lines[i])
            k = i
            if "Join" in lines[i]:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)
