"""Realtime messages: typed parsing, latest state, subscriptions, gaps, catch-up, rollups."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.numbers import exact_sum
from remitlens.operators.contract_events import once
from remitlens.operators.scans import ROWS_PER_BLOCK, previous_row, quantile_blocks
from remitlens.sources.payloads import NUMBER_KINDS

# Required fields of every message type, s = string, n = number, b = boolean.
MESSAGE_FIELDS = {
    "snapshot_update": {"snapshot_id": "s", "epoch": "n", "timestamp": "s", "hash": "s"},
    "corridor_update": {"corridor_id": "s", "corridor_key": "s", "success_rate": "n", "volume_usd": "n", "total_transactions": "n"},
    "anchor_update": {"anchor_id": "s", "name": "s", "reliability_score": "n", "status": "s"},
    "ping": {"timestamp": "n"},
    "pong": {"timestamp": "n"},
    "connected": {"connection_id": "s"},
    "error": {"message": "s"},
    "health_alert": {"corridor_id": "s", "severity": "s", "message": "s", "timestamp": "s"},
    "new_payment": {"corridor_id": "s", "amount": "n", "successful": "b", "timestamp": "s"},
    "subscription_confirm": {},
}
SEVERITIES = ["info", "warning", "error", "critical"]
STALE_SECONDS = 30
_TEXT = ["corridor_id", "corridor_key", "anchor_id", "name", "status", "severity", "message", "timestamp", "snapshot_id", "hash", "connection_id"]
_NUMBER = ["success_rate", "volume_usd", "total_transactions", "reliability_score", "amount", "epoch"]


def _kind_of(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))


def _is(name: str, kind: str) -> Column:
    found = _kind_of(name)
    test = {"s": found == "STRING", "n": found.rlike(NUMBER_KINDS), "b": found == "BOOLEAN"}[kind]
    return F.coalesce(test, F.lit(False))


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Typed messages. Text that is not JSON, not an object, or has no string ``type`` is dropped;
    a known type with all its fields keeps its kind; everything else has kind ``unknown``."""
    parsed = once(df, _v=F.try_parse_json(F.col(value)))
    typed = once(parsed, type=F.when(_is("type", "s"), F.try_variant_get("_v", "$.type", "string")))
    typed = typed.where(F.col("type").isNotNull())
    kind = F.lit("unknown")
    for name, fields in MESSAGE_FIELDS.items():
        tests = [_is(field, k) for field, k in fields.items()]
        if "severity" in fields:
            tests.append(F.try_variant_get("_v", "$.severity", "string").isin(SEVERITIES))
        valid = reduce(lambda a, b: a & b, tests, F.lit(True))
        kind = F.when((F.col("type") == name) & valid, F.lit(name)).otherwise(kind)
    columns = {"kind": kind, "successful": F.try_variant_get("_v", "$.successful", "boolean")}
    columns.update({name: F.try_variant_get("_v", f"$.{name}", "string") for name in _TEXT})
    columns.update({name: F.try_variant_get("_v", f"$.{name}", "double") for name in _NUMBER})
    return once(typed, **columns).drop("_v")


def latest_state(messages: DataFrame, kind: str, key: str, order: list[str]) -> DataFrame:
    """Last update of every corridor or anchor. On a stream: an update-mode aggregation with one row of state per key."""
    return (
        messages.where(F.col("kind") == kind)
        .groupBy(key)
        .agg(F.max_by(F.struct(*[c for c in messages.columns if c != key]), F.struct(*order)).alias("r"))
        .select(key, "r.*")
    )


def channel() -> Column:
    """Subscription channel a message belongs to, null when it has none."""
    kind = F.col("kind")
    return (
        F.when(kind == "corridor_update", F.concat(F.lit("corridor:"), F.col("corridor_key")))
        .when(kind == "new_payment", F.concat(F.lit("payments:"), F.col("corridor_id")))
        .when(kind == "anchor_update", F.concat(F.lit("anchor:"), F.col("anchor_id")))
    )


def subscribed(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages delivered to each subscriber: an equi-join on the channel (stream-static on a stream)."""
    return messages.withColumn("channel", channel()).join(subscriptions, "channel")


def stale_gaps(messages: DataFrame, connection: str, seconds: int = STALE_SECONDS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Silences longer than the limit between consecutive messages of a connection."""
    scanned = previous_row(
        messages, [connection], ["received_at", "event_id"], ["received_at"], quantile_blocks(messages, "received_at", rows_per_block), "_prev"
    )
    before, now = F.col("_prev.received_at"), F.col("received_at")
    gap = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return scanned.where(gap > seconds).select(connection, before.alias("silent_from"), now.alias("silent_to"), gap.alias("gap_seconds"))


def catch_up(corridors: DataFrame, anchors: DataFrame, since: datetime, data_types: list[str]) -> DataFrame:
    """Rows of the requested types that changed after ``since``; both inputs have (id, updated_at, payload)."""
    parts = {"corridor": corridors, "anchor": anchors}
    picked = [
        parts[name].where(F.col("updated_at") > F.lit(since)).select(F.lit(name).alias("type"), "id", "updated_at", "payload")
        for name in data_types
        if name in parts
    ]
    return reduce(lambda a, b: a.unionByName(b), picked)


def catch_up_summary(updates: DataFrame) -> DataFrame:
    return updates.groupBy("type").agg(F.count("*").alias("updates"), F.max("updated_at").alias("last_update"))


def payment_rollup(payments: DataFrame, window: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """Count, failures and volume per corridor and window. The watermark bounds the state on a stream."""
    if payments.isStreaming:
        payments = payments.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (
        payments.groupBy(F.window("ts", window).alias("w"), "corridor")
        .agg(
            F.count("*").alias("payments"),
            F.count_if(~F.col("successful")).alias("failures"),
            exact_sum("amount_usd").alias("volume_usd"),
        )
        .select(F.col("w.start").alias("window_start"), "corridor", "payments", "failures", "volume_usd")
    )


def session_windows(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions as they close: start, end and number of events of each."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (
        events.groupBy(F.session_window("ts", gap).alias("s"), user)
        .agg(F.count("*").alias("events"))
        .select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
    )
