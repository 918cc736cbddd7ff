"""Batches that become visible at once, erasure by file and files by size."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from remitlens.sources import commits, sinks

ROWS = "id bigint, user_id bigint"


def _rows(spark, start, end, files=1):
    return spark.range(start, end, 1, files).selectExpr("id", "id div 10 AS user_id")


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_failure_between_two_parts_shows_neither(spark, tmp_path):
    path = str(tmp_path / "store")
    assert commits.read(spark, path, "a", ROWS).count() == 0
    with commits.batch(spark, path, 0) as b:
        b.part("a")(_rows(spark, 0, 5))
        b.part("b")(_rows(spark, 5, 6))
    with pytest.raises(OSError):
        with commits.batch(spark, path, 1) as b:
            b.part("a")(_rows(spark, 10, 20))
            raise OSError
    assert _ids(commits.read(spark, path, "a", ROWS)) == list(range(5)) and _ids(commits.read(spark, path, "b", ROWS)) == [5]
    assert not list(Path(path).glob("data/a/1/*"))


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "store")
    for n in (5, 3):
        with commits.batch(spark, path, 4) as b:
            b.part("a")(_rows(spark, 0, n))
    with pytest.raises(ValueError):
        with commits.batch(spark, path, 4) as b:
            b.part("a")(_rows(spark, 0, 9))
            raise ValueError
    assert _ids(commits.read(spark, path, "a", ROWS)) == [0, 1, 2]


def test_an_attempt_in_progress_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    with commits.batch(spark, path, 0) as b:
        b.part("a")(_rows(spark, 0, 3))
        assert commits.read(spark, path, "a", ROWS).count() == 0
    assert commits.read(spark, path, "a", ROWS).count() == 3


def test_erasure_leaves_other_files_as_they_are(spark, tmp_path):
    path = str(tmp_path / "my store")
    for batch_id in (0, 1):
        with commits.batch(spark, path, batch_id) as b:
            b.part("a")(_rows(spark, 100 * batch_id, 100 * batch_id + 100, 5).union(spark.sql("select -1L, cast(null as bigint)")))
    before = {f: (Path(path) / f).read_bytes() for f in commits.live_files(spark, path, "a")}
    users = spark.createDataFrame([(3,), (3,), (14,), (None,), (999,)], "user_id bigint")
    taken = commits.erase_users(spark, path, "a", ROWS, users)
    after = commits.live_files(spark, path, "a")
    assert len(taken) == 2 and not any((Path(path) / f).exists() for f in taken)
    assert all((Path(path) / f).read_bytes() == body for f, body in before.items() if f not in taken)
    assert set(before) - set(taken) <= set(after)
    assert _ids(commits.read(spark, path, "a", ROWS)) == [-1, -1, *[i for i in range(200) if i // 10 not in (3, 14)]]
    assert commits.erase_users(spark, path, "a", ROWS, users) == []


def test_a_stopped_erasure_is_finished_by_the_next(spark, tmp_path):
    path = str(tmp_path / "store")
    with commits.batch(spark, path, 0) as b:
        b.part("a")(_rows(spark, 0, 20))
    old = commits.live_files(spark, path, "a")[0]
    body = (Path(path) / old).read_bytes()
    users = spark.createDataFrame([(1,)], "user_id bigint")
    commits.erase_users(spark, path, "a", ROWS, users)
    (Path(path) / old).write_bytes(body)  # as if the driver was lost before the old file was deleted
    commits.erase_users(spark, path, "a", ROWS, users)
    assert not (Path(path) / old).exists() and _ids(commits.read(spark, path, "a", ROWS)) == list(range(10))


def test_files_of_a_hot_day_follow_its_bytes(spark, tmp_path):
    path = str(tmp_path / "logs")
    size = F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(0))
    logs = spark.range(0, 60_000, 1, 8).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + size * 86_400).cast("timestamp_ntz").alias("event_time"),
        F.array().cast("array<string>").alias("tags"), F.sha2(F.col("id").cast("string"), 512).alias("message"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "512KB")
        sinks.route_logs(logs, path)
    finally:
        spark.conf.set(key, old)
    files = {d.name: len(list(d.glob("batch=0/*.parquet"))) for d in (tmp_path / "logs" / "all").glob("log_date=*")}
    hot = files.pop(f"log_date={datetime(2024, 1, 1):%Y-%m-%d}")
    # days that share no shuffle partition with the hot one are one file each
    assert 4 <= hot <= 30 and len(files) == 6 and sorted(files.values())[:3] == [1, 1, 1]
    assert spark.read.parquet(f"{path}/all").count() == 60_000
