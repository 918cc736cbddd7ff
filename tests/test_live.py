"""Stateful streams against their batch twins, over several batches and restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from remitlens.operators import alerts as al
from remitlens.streaming import jobs, live
from remitlens.streaming import messages as msg

START = datetime(2024, 1, 1)


def run_in_parts(spark, tmp_path, rows, schema, time, build, parts, beats=2):
    """Feed ``rows`` in ``parts`` batches, each in a run of its own from the same checkpoint, then close with heartbeats."""
    source, path = f"{tmp_path}/in", f"{tmp_path}/run"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = lambda: build(live.with_heartbeat(spark.readStream.schema(schema).parquet(source), path))
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts < 0 else rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(2).write.mode("append").parquet(source)
        jobs.run_to_files(stream(), path, "append").awaitTermination()
    for k in range(beats):
        live.beat(spark, path, time, START + timedelta(days=400 + k))
        jobs.run_to_files(stream(), path, "append").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@pytest.mark.parametrize("parts", [1, 3])
def test_hold_equals_its_batch_twin(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(f"s{s}" if s else None, START + timedelta(seconds=30 * i), rng.random() < 0.85) for s in range(3) for i in range(120)]
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows) - 8, 8):  # out of order within the watermark
        rows[i : i + 8] = rng.sample(rows[i : i + 8], 8)
    schema = "series string, evaluated_at timestamp, firing boolean"
    build = lambda df: live.hold(df.withWatermark("evaluated_at", "10 minutes"), ["series"], 300)
    got = {tuple(r) for r in run_in_parts(spark, tmp_path, rows, schema, "evaluated_at", build, parts).collect()}
    twin = {tuple(r) for r in al.hold(spark.createDataFrame(rows, schema), ["series"], 300).collect()}
    assert twin and got == twin


@pytest.mark.parametrize("parts", [1, 3])
def test_silences_equal_their_batch_twin(spark, tmp_path, parts):
    rng = random.Random(9)
    rows = [(f"c{rng.randrange(6)}", START + timedelta(seconds=rng.uniform(0, 3000))) for _ in range(400)]
    rows += [("hot", START + timedelta(seconds=i)) for i in range(0, 3000, 5) if not 1000 < i < 1100]
    rows.sort(key=lambda r: r[1])
    schema = "connection string, received_at timestamp"
    got = run_in_parts(spark, tmp_path, rows, schema, "received_at", lambda df: live.silences(df, 30), parts)
    got = {tuple(r) for r in got.where("connection is not null").collect()}
    feed = spark.createDataFrame(rows, schema).withColumn("event_id", F.monotonically_increasing_id())
    twin = {(r.connection, r.silent_from) for r in msg.stale_gaps(feed, "connection", 30).collect()}
    ends = {}
    for c, t in rows:
        ends[c] = max(t, ends.get(c, t))
    assert twin and got == twin | set(ends.items())


def test_a_busy_connection_is_one_row_per_task():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(["hot"] * 5000 + ["b"]), pa.array([*range(k * 5000, k * 5000 + 5000), k])], names=["c", "t"]) for k in range(4)]
    (out,) = live._runs(10)(iter(batches))
    assert sorted(zip(*(c.to_pylist() for c in out.columns))) == [("b", 0, 3), ("hot", 0, 19999)]


def test_chained_windows_and_hold(spark, tmp_path):
    """Error ratio in sliding windows, then a hold on it, as one stream."""
    rng = random.Random(4)
    rows = [(START + timedelta(seconds=20 * i), 500 if rng.random() < (0.4 if 100 < i < 260 else 0.02) else 200) for i in range(500)]
    schema = "event_time timestamp, http_status int"

    def build(df):
        ratio = al.error_ratio(df.withWatermark("event_time", "1 minute"), limit=0.2).withColumn("series", F.lit("5xx"))
        return live.hold(ratio.select("series", F.col("_closed").alias("evaluated_at"), "firing"), ["series"], 300)

    got = {(r.evaluated_at, r.since) for r in run_in_parts(spark, tmp_path, rows, schema, "event_time", build, 2).collect()}
    ratio = al.error_ratio(spark.createDataFrame(rows, schema), limit=0.2).withColumn("series", F.lit("5xx"))
    step = timedelta(microseconds=1)  # the window's last moment
    twin = {(r.evaluated_at - step, r.since - step) for r in al.hold(ratio, ["series"], 300).collect()}
    assert twin and got == twin


def test_a_subscription_counts_from_the_next_batch(spark, tmp_path):
    source, root, path = f"{tmp_path}/in", f"{tmp_path}/subscriptions", f"{tmp_path}/run"
    schema = "event_id long, kind string, corridor_key string, corridor_id string, anchor_id string"
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    pairs = lambda rows: spark.createDataFrame(rows, "subscriber string, channel string")

    def batch(i):
        spark.createDataFrame([(i, "corridor_update", "x", None, None), (i + 100, "new_payment", None, "p", None)], schema).write.mode("append").parquet(source)
        live.run_deliveries(stream(), root, path).awaitTermination()

    batch(1)  # nobody has subscribed yet
    live.publish_subscriptions(pairs([("a", "corridor:x")]), root)
    batch(2)
    assert live.publish_subscriptions(pairs([("a", "corridor:x"), ("b", "payments:p"), ("b", "corridor:x")]), root) == 2
    spark.range(7).write.parquet(f"{root}/data/3")  # a version that is being written does not count
    batch(3)
    out = {(r.subscriber, r.event_id, r.version) for r in spark.read.parquet(f"{path}/out").collect()}
    assert out == {("a", 2, 1), ("a", 3, 2), ("b", 3, 2), ("b", 103, 2)}


def test_alert_counts_of_running_windows(spark, tmp_path):
    rows = [(START + timedelta(seconds=7 * i), "error" if i % 3 else "info", 2500 if i % 5 == 0 else 10, "db" if i % 2 else None, "Database x") for i in range(300)]
    schema = "event_time timestamp, log_level string, response_time_ms long, rpc_method string, message string"
    source, path = f"{tmp_path}/in", f"{tmp_path}/run"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).write.mode("append").parquet(source)
        stream = al.log_alerts(spark.readStream.schema(schema).parquet(source).withWatermark("event_time", "1 minute"))
        jobs.run_to_files(stream, path, "update").awaitTermination()
    got = {tuple(r) for r in jobs.latest_rows(spark, path, ["rule", "window_start"]).select("rule", "window_start", "window_end", "count").collect()}
    assert got == {tuple(r) for r in al.log_alerts(spark.createDataFrame(rows, schema)).collect()}
