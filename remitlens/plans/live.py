"""Alerts, silences and deliveries as running streams over the supplied tables, each equal to its batch SQL."""

from datetime import datetime

from pyspark.sql import functions as F

from remitlens.operators import alerts as al
from remitlens.operators import logs as lg
from remitlens.plans import feeds, operations
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import EVENTS
from remitlens.sources.tables import EVENT_KEY, table
from remitlens.streaming import jobs, live, store
from remitlens.streaming import messages as msg

# Later than every event by far: heartbeats that close all windows.
_AFTER = [datetime(2100, 1, 1), datetime(2100, 1, 2)]


def _closed(spark, name, rows, time, build):
    """Rows of an append-mode stream once its input is used up and two heartbeats have passed."""
    path = jobs.stream_dir(spark, name)
    stream = lambda: jobs.run_to_files(build(live.with_heartbeat(rows, path)), path, "append")
    stream().awaitTermination()
    for at in _AFTER:
        live.beat(spark, path, time, at)
        stream().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def _log_stream(spark, sf):
    rows = feeds.event_stream(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", F.expr(EVENT_KEY).alias("k"))
    return lg.shape_logs(operations.raw_logs(spark, sf, rows))


@query("stream_log_alerts", operations.LOG_ALERTS_SQL)
def stream_log_alerts(spark, sf):
    logs = _log_stream(spark, sf).withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", "1 hour")
    path = jobs.stream_dir(spark, "log-alerts")
    jobs.run_to_files(al.log_alerts(logs, window="6 hours"), path, "update").awaitTermination()
    fired = jobs.latest_rows(spark, path, ["rule", "window_start"])
    return fired.select("rule", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "count")


def _requests(spark, sf):
    return _log_stream(spark, sf).where(F.col("http_method").isNotNull()).select(F.col("event_time").cast("timestamp").alias("event_time"), "http_status")


def _ratios(rows):
    return al.error_ratio(rows.withWatermark("event_time", "1 hour"), window="6 hours", slide="1 hour", limit=0.2)


@query("stream_error_ratio", operations.ERROR_RATIO_SQL)
def stream_error_ratio(spark, sf):
    out = _closed(spark, "error-ratio", _requests(spark, sf), "event_time", _ratios)
    out = out.where(F.col("evaluated_at") < F.lit(_AFTER[0]))  # without the windows of the heartbeats themselves
    return rounded(out.select(F.col("evaluated_at").cast("timestamp_ntz").alias("evaluated_at"), "ratio", "firing"), ratio=9)


@query("stream_alert_hold", operations.ALERT_HOLD_SQL)
def stream_alert_hold(spark, sf):
    def build(rows):
        ratios = _ratios(rows).select(F.lit("5xx").alias("series"), F.col("_closed").alias("evaluated_at"), "firing")
        return live.hold(ratios, ["series"], seconds=3 * 3600)

    out = _closed(spark, "alert-hold", _requests(spark, sf), "event_time", build)
    # a window is evaluated in its last microsecond
    ends = [(F.col(c) + F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ntz").alias(c) for c in ("evaluated_at", "since")]
    return out.select(*ends)


@query(
    "stream_silences",
    """WITH p AS (SELECT 'U' || user_id AS connection, ts AS silent_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
    SELECT connection, silent_from FROM p WHERE next IS NULL OR epoch_us(next) - epoch_us(silent_from) > 172800000000""",
)
def stream_silences(spark, sf):
    feed = feeds.event_stream(spark, sf).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("connection"), F.col("ts").cast("timestamp").alias("received_at"))
    out = _closed(spark, "silences", feed, "received_at", lambda rows: live.silences(rows, seconds=2 * 86_400))
    return out.where("connection is not null").select("connection", F.col("silent_from").cast("timestamp_ntz").alias("silent_from"))


@query(
    "stream_deliveries",
    f"""{feeds._MSG} SELECT c_custkey AS subscriber, event_id, CAST(1 + event_id % 2 AS INTEGER) AS version
    FROM msg JOIN customer ON 'U' || c_custkey = connection AND CASE WHEN c_mktsegment < 'F' THEN kind = 'corridor_update' ELSE event_id % 2 = 1 AND kind IN ('new_payment', 'anchor_update') END""",
)
def stream_deliveries(spark, sf):
    """Messages with even numbers come first; then a new version of the subscriptions; then the others."""
    path = jobs.stream_dir(spark, "deliveries")
    texts, root = feeds.message_text(spark, sf), f"{path}/subscriptions"
    wanted = feeds.subscriptions(spark, sf)
    stream = lambda: live.run_deliveries(msg.parse_messages(spark.readStream.schema(texts.schema).parquet(f"{path}/in")), root, path)
    for part, known in ((0, wanted.where(F.col("channel").startswith("corridor:"))), (1, wanted)):
        live.publish_subscriptions(known, root)
        texts.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        stream().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("subscriber", "event_id", "version")


@query("stream_state_store", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY 1")
def stream_state_store(spark, sf):
    """Latest state over several batches, kept in a merged store."""
    path = jobs.stream_dir(spark, "state-store")
    table(spark, sf, "events").select("user_id", "event_id", "value", F.col("event_type").alias("kind")).repartition(6, "event_id").write.parquet(f"{path}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    state = msg.latest_state(rows, "click", "user_id", ["event_id"])
    store.run_to_store(state, path, ["user_id"]).awaitTermination()
    return store.latest(spark, path, ["user_id"], state.schema).select("user_id", "event_id", "value")
