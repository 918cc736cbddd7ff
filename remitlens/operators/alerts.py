"""Threshold alerts over logs, counters and metrics, and user-defined alert rules.

Sliding windows are fed from small fixed buckets: rows are counted once per
bucket, and only the bucket rows are spread over the windows that contain them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.numbers import exact_sum, safe_div
from remitlens.operators.scans import ROWS_PER_BLOCK, previous_max, previous_row, quantile_blocks

# Alert thresholds (a window fires above the count).
ERROR_COUNT, SLOW_COUNT, RPC_ERROR_COUNT, DATABASE_ERROR_COUNT = 10, 5, 3, 1
SLOW_MS = 2000
ERROR_RATIO, P99_SECONDS, LAG_SECONDS = 0.05, 1.0, 300
FAILURE_RATE, SLOW_QUERY_RATE = 0.1, 10.0
POOL_RATIO, CACHE_FAILURE_RATIO, MEMORY_RATIO = 0.8, 0.01, 0.85
CLAMP = 0.0001


def log_alert_rules() -> dict[str, tuple[Column, int]]:
    """Rule name -> (row test, threshold). The level test is lower case only."""
    error = F.col("log_level") == "error"
    return {
        "high_error_rate": (error, ERROR_COUNT),
        "slow_responses": (F.col("response_time_ms") >= SLOW_MS, SLOW_COUNT),
        "rpc_failures": (error & F.col("rpc_method").isNotNull(), RPC_ERROR_COUNT),
        "database_errors": (error & F.lower("message").contains("database"), DATABASE_ERROR_COUNT),
    }


def log_alerts(logs: DataFrame, time: str = "event_time", window: str = "5 minutes", rules=None) -> DataFrame:
    """Firing windows of every rule: one pass and one aggregation for all rules."""
    rules = rules or log_alert_rules()
    counts = logs.groupBy(F.window(time, window).alias("w")).agg(
        *[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, (test, _) in rules.items()]
    )
    fired = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(name).alias("count"), F.lit(limit).alias("threshold"))
            for name, (_, limit) in rules.items()
        ]
    )
    return (
        counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.inline(fired))
        .where(F.col("count") > F.col("threshold"))
        .select("rule", "window_start", "window_end", "count")
    )


def _bucketed(df: DataFrame, time: str, slide: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    # the window itself, not its start: it carries the watermark to a second aggregate
    return df.groupBy(*keys, F.window(time, slide).alias("_bucket")).agg(*aggregates)


def error_ratio(logs: DataFrame, time: str = "event_time", window: str = "5 minutes", slide: str = "30 seconds", limit: float = ERROR_RATIO) -> DataFrame:
    """Share of 5xx responses per sliding window and whether it exceeds the limit.

    On a stream with a watermark on ``time`` the two aggregates are chained (append
    mode): a window appears once the watermark has passed its end.
    """
    buckets = _bucketed(
        logs, time, slide, [],
        [F.count("*").alias("n"), F.count_if(F.col("http_status").between(500, 599)).alias("bad")],
    )
    ratio = safe_div(F.sum("bad"), F.sum("n"))
    windows = buckets.groupBy(F.window("_bucket", window, slide).alias("w")).agg(ratio.alias("ratio"))
    closed = [F.window_time("w").alias("_closed")] if logs.isStreaming else []
    return windows.select(F.col("w.end").alias("evaluated_at"), "ratio", (F.col("ratio") > limit).alias("firing"), *closed)


def hold(evaluations: DataFrame, keys: list[str], seconds: int = 300, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Evaluations whose condition has been true for at least ``seconds``.

    The last false evaluation before a row identifies its true stretch; the
    stretch start is an aggregate per (key, last false) joined back.
    """
    stamped = evaluations.withColumn("_false", F.when(~F.col("firing"), F.col("evaluated_at")))
    scanned = previous_max(stamped, keys, ["evaluated_at"], "_false", quantile_blocks(stamped, "evaluated_at", rows_per_block), "_since_false")
    true = scanned.where("firing").withColumn("_stretch", F.coalesce(F.unix_micros(F.col("_since_false").cast("timestamp")), F.lit(-1)))
    # a struct keeps the stretches of a null key together
    true = true.withColumn("_stretch", F.struct(*keys, "_stretch"))
    starts = true.groupBy("_stretch").agg(F.min("evaluated_at").alias("since"))
    joined = true.join(starts, "_stretch")
    lasted = F.timestamp_diff("SECOND", F.col("since"), F.col("evaluated_at"))
    return joined.where(lasted >= seconds).select(*keys, "evaluated_at", "since")


def histogram_quantile(df: DataFrame, keys: list[str], seconds: str, edges: list[float], q: float) -> DataFrame:
    """Quantile from bucket counts, linear inside the bucket; above the last edge it is the last edge."""
    cumulative = [F.count_if(F.col(seconds) <= e).alias(f"_c{i}") for i, e in enumerate(edges)]
    counted = df.groupBy(*keys).agg(F.count(seconds).alias("_n"), *cumulative)
    rank = F.col("_n") * F.lit(q)
    steps = []
    for i, edge in enumerate(edges):
        low = edges[i - 1] if i else 0.0
        below = F.col(f"_c{i - 1}") if i else F.lit(0)
        inside = F.col(f"_c{i}") - below
        share = F.coalesce(safe_div(rank - below, F.nullif(inside, F.lit(0))), F.lit(0.0))
        steps.append(F.when(F.col(f"_c{i}") >= rank, F.lit(float(low)) + F.lit(float(edge - low)) * share))
    return counted.select(*keys, F.coalesce(*steps, F.lit(float(edges[-1]))).alias("quantile"))


def latency_alert(df: DataFrame, keys: list[str], seconds: str, limit: float = P99_SECONDS, approximate: bool = False) -> DataFrame:
    """p99 per key above the limit, from raw values."""
    if approximate:
        out = df.groupBy(*keys).agg(F.percentile_approx(seconds, 0.99, 10_000).alias("p99"))
    else:
        from remitlens.operators.scans import exact_percentiles

        out = exact_percentiles(df, keys, seconds, {"p99": 0.99})
    return out.where(F.col("p99") > limit)


def counter_rate(samples: DataFrame, keys: list[str], order: list[str], window: str, seconds: float, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Increase per second of counters; a drop is a reset that counts from zero."""
    scanned = previous_row(samples, keys, order, ["value"], quantile_blocks(samples, "ts", rows_per_block), "_prev")
    before = F.col("_prev.value")
    step = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return (
        scanned.where(F.col("_prev").isNotNull())
        .groupBy(*keys, F.window("ts", window)["start"].alias("window_start"))
        .agg((exact_sum(step) / seconds).alias("rate"))
    )


def gauge_ratio_alert(gauges: DataFrame, used: str, capacity: str, limit: float) -> DataFrame:
    """Rows whose used / capacity exceeds the limit."""
    return gauges.withColumn("ratio", safe_div(F.col(used), F.nullif(F.col(capacity), F.lit(0)))).where(F.col("ratio") > limit)


def ingestion_lag(rows: DataFrame, as_of: datetime, limit: int = LAG_SECONDS) -> DataFrame:
    """Seconds since the last row of each network and whether they exceed the limit."""
    last = rows.groupBy("network").agg(F.max("ts").alias("last_ts"))
    lag = F.timestamp_diff("SECOND", F.col("last_ts").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    return last.withColumn("lag_seconds", lag).withColumn("firing", F.col("lag_seconds") > limit)


def request_panels(logs: DataFrame, time: str = "event_time", window: str = "5 minutes", seconds: float = 300.0) -> DataFrame:
    """Request rate and mean latency per endpoint and method; the divisor is at least 0.0001."""
    return (
        logs.where(F.col("http_method").isNotNull())
        .groupBy(F.window(time, window)["start"].alias("window_start"), F.col("http_path").alias("endpoint"), F.col("http_method").alias("method"))
        .agg(
            (F.count("*") / seconds).alias("rate"),
            (exact_sum("response_time_ms") / F.greatest(F.count("response_time_ms").cast("double"), F.lit(CLAMP))).alias("mean_latency_ms"),
        )
    )


def hit_ratio(operations: DataFrame, time: str, window: str, seconds: float, hit: Column) -> DataFrame:
    """Cache hit rate over operation rate per window, clamped divisor."""
    return operations.groupBy(F.window(time, window)["start"].alias("window_start")).agg(
        ((F.count_if(hit) / seconds) / F.greatest(F.count("*") / seconds, F.lit(CLAMP))).alias("hit_ratio")
    )


def rate_by(df: DataFrame, keys: list[str], time: str, window: str, seconds: float) -> DataFrame:
    return df.groupBy(F.window(time, window)["start"].alias("window_start"), *keys).agg((F.count("*") / seconds).alias("rate"))


def corridor_measures(metrics: DataFrame) -> DataFrame:
    """Long form (corridor, metric_type, value) of the metrics that alert rules may name."""
    columns = {
        "success_rate": "success_rate", "latency": "average_latency_ms", "liquidity": "liquidity_depth_usd",
        "volume": "liquidity_volume_24h_usd",
    }
    pairs = [F.struct(F.lit(k).alias("metric_type"), F.col(c).cast("double").alias("value")) for k, c in columns.items()]
    return metrics.select("corridor", F.inline(F.array(*pairs)))


def apply_alert_rules(measures: DataFrame, rules: DataFrame, as_of: datetime) -> DataFrame:
    """Alert history rows of active, unsnoozed rules.

    A measure meets the rules for its corridor and those for all corridors in one
    equi-join: it is offered once under its own corridor and once under null,
    which is what a rule for all corridors names.
    """
    live = rules.where(F.col("is_active") & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= F.lit(as_of))))
    scopes = F.array_distinct(F.array(F.col("corridor"), F.lit(None).cast("string")))
    offered = measures.withColumn("_scope", F.explode(scopes)).withColumnRenamed("metric_type", "_metric")
    matched = offered.join(live, (F.col("_metric") == F.col("metric_type")) & F.col("_scope").eqNullSafe(F.col("corridor_id")))
    condition = F.col("condition")
    fires = (
        F.when(condition == "above", F.col("value") > F.col("threshold"))
        .when(condition == "below", F.col("value") < F.col("threshold"))
        .when(condition == "equals", F.col("value") == F.col("threshold"))
        .otherwise(F.lit(False))
    )
    return matched.where(fires).select(
        "rule_id",
        "corridor",
        "metric_type",
        "condition",
        F.col("value").alias("trigger_value"),
        F.col("threshold").alias("threshold_value"),
        F.concat_ws(" ", "metric_type", F.lit("of"), "corridor", F.lit("is"), "condition", F.lit("threshold")).alias("message"),
    )
