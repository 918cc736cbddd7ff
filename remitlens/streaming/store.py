"""Latest row per key of an update stream, in few folders however many batches there were.

Every batch writes a folder of level 0. As soon as a level has ``fan`` folders they are
merged, newest row per key, into one of the next level (a log-structured merge), so a
reader opens at most ``fan`` - 1 folders a level. A list of the live folders is written
last under the batch's number: it is what makes a batch visible. A batch that runs
again starts from the list of the batch before and replaces its own folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from remitlens.streaming import jobs

FAN = 4
_BATCH = "_batch"


def _lists(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the lists that were written whole, rising."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/live")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n) for n in names if n.isdigit() and jobs.exists(spark, f"{path}/live/{n}/_SUCCESS"))


def live_folders(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[int, str]]:
    """(level, folder) of what a reader has to open, as of the last batch (below ``before``)."""
    numbers = [n for n in _lists(spark, path) if before is None or n < before]
    if not numbers:
        return []
    rows = spark.read.schema("level int, folder string").parquet(f"{path}/live/{numbers[-1]}").collect()  # a few per level
    return sorted((r.level, r.folder) for r in rows)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), _BATCH).alias("_r"))
    return latest.select(*keys, "_r.*")


def _read(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{path}/data/{f}") for f in folders])


def store_batch(batch: DataFrame, path: str, keys: list[str], batch_id: int, fan: int = FAN) -> None:
    """Add the rows of one batch, one per key; a null key is a key of its own."""
    spark = batch.sparkSession
    rows = batch.withColumn(_BATCH, F.lit(batch_id).cast("long"))
    live = live_folders(spark, path, before=batch_id)
    level, folder = 0, f"0-{batch_id}"
    rows.write.mode("overwrite").parquet(f"{path}/data/{folder}")
    live.append((level, folder))
    while len(full := [f for n, f in live if n == level]) >= fan:
        live = [x for x in live if x[0] != level]
        level, folder = level + 1, f"{level + 1}-{batch_id}"
        _newest(_read(spark, path, full, rows.schema), keys).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/data/{folder}")
        live.append((level, folder))
    spark.createDataFrame(live, "level int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/live/{batch_id}")


def run_to_store(df: DataFrame, path: str, keys: list[str], fan: int = FAN) -> StreamingQuery:
    """Keep the latest row per key of an update-mode stream."""
    return jobs._start(df, path, lambda batch, batch_id: store_batch(batch, path, keys, batch_id, fan), "update")


def latest(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """Current row per key; no rows before the first batch. ``schema`` is that of the stored rows."""
    folders = [f for _, f in live_folders(spark, path)]
    if not folders:
        return spark.createDataFrame([], schema)
    full = spark.createDataFrame([], schema).withColumn(_BATCH, F.lit(0).cast("long")).schema
    return _newest(_read(spark, path, folders, full), keys).select(*schema.fieldNames())
