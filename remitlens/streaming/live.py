"""Alerts, silences and deliveries on running streams.

The operators are those of the batch library, or stateful processors whose result
equals its batch twin once the watermark has passed. State lives in RocksDB; it is
cleared by event-time timers, so it holds what may still change and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from remitlens.streaming import jobs
from remitlens.streaming import messages as msg

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State off the heap, and state types that only this provider has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


# --- heartbeats -------------------------------------------------------------------------------------


def with_heartbeat(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` and those that ``beat`` adds: they move the watermark while nothing else arrives."""
    spark, folder = rows.sparkSession, f"{path}/heartbeat"
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(folder)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))


def beat(spark: SparkSession, path: str, time: str, at) -> None:
    """One row that holds nothing but a time."""
    folder = f"{path}/heartbeat"
    schema = spark.read.parquet(folder).schema
    stamp = F.lit(at).cast(schema[time].dataType)
    columns = [(stamp if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    spark.range(1).select(*columns).write.mode("append").parquet(folder)


# --- a condition that holds --------------------------------------------------------------------------


class _Hold(StatefulProcessor):
    """Evaluations wait until the watermark has passed them, then move the start of the true stretch."""

    def __init__(self, micros: int):
        self._micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getMapState("pending", "at long", "firing boolean")
        self._since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, firing in zip(batch["at_micros"].tolist(), batch["firing"].tolist()):
                self._pending.updateValue((at,), (bool(firing),))
                self._handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((k[0], v[0]) for k, v in self._pending.iterator() if k[0] <= passed)
        since = self._since.get()[0] if self._since.exists() else None
        out = []
        for at, firing in due:
            self._pending.removeKey((at,))
            since = (at if since is None else since) if firing else None
            if firing and at - since >= self._micros:
                out.append((*key, at, since))
        if since is None:
            self._since.clear()
        else:
            self._since.update((since,))
        if out:
            yield pd.DataFrame(out, columns=[*self._names(len(key)), "at", "since"])

    @staticmethod
    def _names(n: int) -> list[str]:
        return [f"k{i}" for i in range(n)]

    def close(self) -> None:
        pass


def hold(evaluations: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """``alerts.hold`` on a stream of (keys, evaluated_at, firing) that has a watermark on ``evaluated_at``.

    Evaluations may come in any order within the watermark; later ones are dropped.
    """
    keep_state_in_rocksdb(evaluations.sparkSession)
    rows = evaluations.select(*keys, F.unix_micros(F.col("evaluated_at").cast("timestamp")).alias("at_micros"), F.coalesce("firing", F.lit(False)).alias("firing"), "evaluated_at")
    kinds = ", ".join(f"k{i} {evaluations.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    held = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Hold(seconds * 1_000_000), outputStructType=f"{kinds}, at long, since long", outputMode="Append", timeMode="EventTime"
    )
    kind = evaluations.schema["evaluated_at"].dataType
    return held.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.timestamp_micros("at").cast(kind).alias("evaluated_at"),
        F.timestamp_micros("since").cast(kind).alias("since"),
    )


# --- silent connections ------------------------------------------------------------------------------


def _runs(limit: int):
    """Times of a task as runs without a silence in them: a busy connection is one row per task."""
    schema = pa.schema([("connection", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches):
        open_: dict[str, list[list[int]]] = {}
        for batch in batches:
            for connection, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_.setdefault(connection, []).append([at, at])
            open_ = {c: _merged(own, limit) for c, own in open_.items()}
        rows = [(c, a, b) for c, own in open_.items() for a, b in own]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else ([], [], []), schema)], schema=schema)

    return run


def _merged(runs: list[list[int]], limit: int) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first - out[-1][1] <= limit:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


class _Silences(StatefulProcessor):
    """Runs of messages of one connection that the watermark has not left behind by the limit yet."""

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("runs", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = [list(r) for r in self._open.get()]
        for batch in rows:
            runs += [list(r) for r in zip(batch["first"].tolist(), batch["last"].tolist())]
        runs = _merged(runs, self._limit)
        self._open.put([tuple(r) for r in runs])
        for _, last in runs:
            self._handle.registerTimer((last + self._limit) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        runs = [tuple(r) for r in self._open.get()]
        over = [r for r in runs if r[1] + self._limit < passed]
        rest = [r for r in runs if r[1] + self._limit >= passed]
        if rest:
            self._open.put(rest)
        else:
            self._open.clear()
        if over:
            yield pd.DataFrame({"connection": [key[0]] * len(over), "last": [r[1] for r in over]})

    def close(self) -> None:
        pass


def silences(messages: DataFrame, seconds: int = msg.STALE_SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """(connection, silent_from): every message after which nothing came for longer than the limit.

    A row appears as soon as the watermark shows the silence, also when the
    connection never speaks again. Times travel as runs (first, last): a task sends
    one row per connection and silence, however many messages there are.
    """
    keep_state_in_rocksdb(messages.sparkSession)
    limit, kind = seconds * 1_000_000, messages.schema["received_at"].dataType
    times = messages.select("connection", F.unix_micros(F.col("received_at").cast("timestamp")).alias("at")).where("at is not null")
    runs = times.mapInArrow(_runs(limit), "connection string, first long, last long")
    runs = runs.withColumn("heard", F.timestamp_micros("last")).withWatermark("heard", watermark)
    found = runs.groupBy("connection").transformWithStateInPandas(
        statefulProcessor=_Silences(limit), outputStructType="connection string, last long", outputMode="Append", timeMode="EventTime"
    )
    return found.select("connection", F.timestamp_micros("last").cast(kind).alias("silent_from"))


# --- deliveries --------------------------------------------------------------------------------------


def publish_subscriptions(subscriptions: DataFrame, root: str) -> int:
    """Store a new version of all subscriptions; it counts from the moment its line is in the list of versions."""
    spark = subscriptions.sparkSession
    version = newest_version(spark, root) + 1
    subscriptions.write.mode("overwrite").parquet(f"{root}/data/{version}")
    spark.range(version, version + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def newest_version(spark: SparkSession, root: str) -> int:
    """The last version that was published whole; 0 before the first."""
    if not jobs.exists(spark, f"{root}/versions"):
        return 0
    return spark.read.schema("version long").parquet(f"{root}/versions").agg(F.max("version").alias("v")).first().v or 0


def run_deliveries(messages: DataFrame, root: str, path: str) -> StreamingQuery:
    """Deliver every batch of messages by the subscriptions of that moment.

    The version is read anew for each batch and noted under the batch number before
    anything is delivered, so a batch that runs again delivers by the same version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, note = batch.sparkSession, f"{path}/noted/{batch_id}"
        if not jobs.exists(spark, f"{note}/_SUCCESS"):
            version = newest_version(spark, root)
            spark.range(version, version + 1).toDF("version").coalesce(1).write.mode("overwrite").parquet(note)
        version = spark.read.parquet(note).first().version
        if version:
            delivered = msg.subscribed(batch, spark.read.parquet(f"{root}/data/{version}")).withColumn("version", F.lit(version))
            delivered.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return jobs._start(messages, path, write, "append")
