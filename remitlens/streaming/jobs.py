"""Running streams: file source to file sink, restartable from their checkpoint.

Every batch writes into a directory named by its batch number, so a batch that
runs again after a lost executor or driver replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from remitlens.operators import contract_events as ev
from remitlens.operators.logs import shape_logs
from remitlens.session import shared_dir
from remitlens.sources import sinks
from remitlens.streaming import messages as msg

# Lengths of the realtime lists.
ALERT_LIST, PAYMENT_LIST = 50, 100


def stream_dir(spark: SparkSession, name: str) -> str:
    """New folder for one stream's output and checkpoint, in the cluster's shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/remitlens/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the file system it lies in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _start(df: DataFrame, path: str, write, mode: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def run_to_files(df: DataFrame, path: str, mode: str = "update") -> StreamingQuery:
    """Write every batch of a stream under its batch number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return _start(df, path, write, mode)


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value of an update-mode aggregation: the row of the last batch per key."""
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").drop("batch")


def run_event_normalisation(events: DataFrame, path: str, mode: str = "quarantine") -> StreamingQuery:
    """Decode contract events; good and rejected events go to their own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.write_normalized_events(
            ev.decode_snapshot_events(batch),
            lambda good: good.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}"),
            lambda bad: bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch={batch_id}"),
            mode,
        )

    return _start(events, path, write, "append")


def run_log_router(logs: DataFrame, path: str, service: str = "payment-analytics") -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.route_logs(shape_logs(batch, service), f"{path}/logs", batch_id)

    return _start(logs, path, write, "append")


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("received_at"), F.desc("event_id")).limit(n)


def run_bounded_lists(messages: DataFrame, path: str, payments_enabled: bool = True) -> StreamingQuery:
    """Newest 50 alerts and newest 100 payments.

    A batch keeps its own newest rows (a distributed top-n), merges them with
    the list of the batch before (at most n rows) and writes the new list under
    its own number. No per-key state holds a list, so a busy channel costs no more.
    """
    wanted = {"health_alert": ALERT_LIST}
    if payments_enabled:
        wanted["new_payment"] = PAYMENT_LIST

    def write(batch: DataFrame, batch_id: int) -> None:
        for kind, n in wanted.items():
            rows = newest(batch.where(F.col("kind") == kind), n)
            if batch_id > 0:
                before = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/{kind}/{batch_id - 1}")
                rows = newest(rows.unionByName(before), n)
            rows.write.mode("overwrite").parquet(f"{path}/{kind}/{batch_id}")

    return _start(messages, path, write, "append")


def bounded_list(spark: SparkSession, path: str, kind: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}/{batch_id}")


def staleness(messages: DataFrame, seconds: int = msg.STALE_SECONDS) -> DataFrame:
    """Connections that fall silent: a processing-time timer per connection.

    The state is one timestamp. A message re-arms the timer; when it expires a
    row is emitted. A connection's rows of a batch come to Python in Arrow batches, of
    which only the newest time is kept.
    """
    schema = "connection string, last_seen timestamp, stale boolean"

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"connection": [key[0]], "last_seen": [last], "stale": [True]})
            return
        last = max(batch["received_at"].max() for batch in batches)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"connection": [key[0]], "last_seen": [last], "stale": [False]})

    return (
        messages.select("connection", "received_at")
        .groupBy("connection")
        .applyInPandasWithState(watch, schema, "last_seen timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )
