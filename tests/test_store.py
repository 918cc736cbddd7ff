"""The merged store of latest rows against a dictionary."""

import random

from pyspark.sql import types as T

from remitlens.streaming import store

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def rows_of(spark, path):
    return {r.k: r.v for r in store.latest(spark, path, ["k"], SCHEMA).collect()}


def test_latest_rows_in_few_folders(spark, tmp_path):
    rng, path, expected = random.Random(1), f"{tmp_path}/store", {}
    assert rows_of(spark, path) == {}
    for n in range(11):
        batch = {rng.choice(["a", "b", "c", None, f"k{rng.randrange(30)}"]): n * 100 + i for i in range(6)}
        store.store_batch(spark.createDataFrame(list(batch.items()), SCHEMA), path, ["k"], n, fan=3)
        expected |= batch
        folders = store.live_folders(spark, path)
        assert all(sum(level == k for level, _ in folders) < 3 for k in range(4))
    assert len(folders) <= 6 and max(level for level, _ in folders) == 2
    assert rows_of(spark, path) == expected


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/store"
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store.store_batch(frame([("a", 1), ("b", 1)]), path, ["k"], 0, fan=2)
    # lost after its folder was written: nothing of it is visible
    frame([("a", 2)]).write.parquet(f"{path}/data/0-1")
    assert rows_of(spark, path) == {"a": 1, "b": 1}
    for _ in range(2):
        store.store_batch(frame([("a", 3)]), path, ["k"], 1, fan=2)
        assert rows_of(spark, path) == {"a": 3, "b": 1}
        assert store.live_folders(spark, path) == [(1, "1-1")]
