"""Log shaping, usage statistics, client and session analytics, data-subject requests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions import bands
from remitlens.functions.numbers import exact_avg, js_round, pct, safe_div
from remitlens.functions.redaction import drop_sensitive_fields
from remitlens.functions.times import parse_timestamp
from remitlens.operators.scans import ROWS_PER_BLOCK, previous_two, quantile_blocks

# User-agent marks in the order they are tried. A Chromium-based
# Edge also says Chrome and is therefore counted there.
BROWSERS = [("Firefox", "Firefox"), ("Chrome", "Chrome"), ("Safari", "Safari"), ("Edge", "Edge")]
SYSTEMS = [("Windows", "Windows"), ("Mac", "macOS"), ("Linux", "Linux"), ("Android", "Android"), ("iOS", "iOS")]
# Retention tiers, from the oldest down, as (minimum age in days, tier).
RETENTION = [(30, "delete"), (14, "cold"), (7, "warm"), (0, "hot")]


def shape_logs(logs: DataFrame, service: str = "payment-analytics") -> DataFrame:
    """Common form of a structured log: level, time, service, trace id, tags, error text, seconds."""
    level = F.col("level")
    is_error = F.coalesce(level.isin("ERROR", "error"), F.lit(False))
    tags = F.array_compact(
        F.array(
            F.when(is_error, F.lit("error")),
            F.when(level.isin("WARN", "warn"), F.lit("warning")),
            F.when(_present("http_method"), F.lit("http_request")),
            F.when(_present("rpc_method"), F.lit("rpc_call")),
            F.when(_present("query"), F.lit("database")),
        )
    )
    shaped = logs.withColumns(
        {
            "event_time": parse_timestamp(F.col("timestamp")),
            "service": F.lit(service),
            "trace_id": F.when(_present("request_id"), F.col("request_id")),
            "tags": tags,
            "error_message": F.when(is_error, F.col("error.message")),
            "response_time_seconds": F.when(_present("http_method"), F.col("response_time_ms") / 1000.0),
        }
    )
    return drop_sensitive_fields(shaped.withColumnRenamed("level", "log_level").drop("timestamp", "error"))


def _present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def retention_tier(log_date: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, log_date)
    return F.coalesce(*[F.when(age >= days, F.lit(tier)) for days, tier in RETENTION], F.lit("hot"))


def retention(df: DataFrame, as_of: datetime, column: str = "log_date") -> DataFrame:
    """Tier per row; rows due for deletion are left out. On a date-partitioned table the age test prunes partitions."""
    day = as_of.date()
    kept = df.where(F.col(column) > F.lit(day - timedelta(days=RETENTION[0][0])))
    return kept.withColumn("tier", retention_tier(F.col(column), F.lit(day)))


def api_usage(logs: DataFrame) -> DataFrame:
    """Requests, mean response time, error rate (status 400 and above) and health."""
    errors = F.count_if(F.col("http_status") >= 400)
    totals = logs.agg(
        F.count("*").alias("total_requests"),
        F.coalesce(exact_avg("response_time_ms"), F.lit(0.0)).alias("average_response_ms"),
        pct(errors, F.nullif(F.count("*"), F.lit(0))).alias("error_rate"),
    )
    return totals.withColumn("health", F.when(F.col("error_rate") < 5, F.lit("HEALTHY")).otherwise(F.lit("DEGRADED")))


def top_endpoints(logs: DataFrame, limit: int = 10) -> DataFrame:
    return (
        logs.groupBy(F.col("http_path").alias("endpoint"), F.col("http_method").alias("method"))
        .agg(F.count("*").alias("count"), exact_avg("response_time_ms").alias("average_ms"))
        .orderBy(F.desc("count"), "endpoint", "method")
        .limit(limit)
    )


def status_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("http_status").agg(F.count("*").alias("count"))


def web_vitals(metrics: DataFrame) -> DataFrame:
    """Latest value of each vital and its rating."""
    latest = metrics.groupBy("name").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
    return latest.withColumn("rating", bands.vital_rating(F.col("name"), F.col("value")))


def endpoint_latency(metrics: DataFrame) -> DataFrame:
    """Rounded mean latency per endpoint of the ``api-latency`` rows that name one."""
    rows = metrics.where((F.col("name") == "api-latency") & _present("endpoint"))
    return rows.groupBy("endpoint").agg(js_round(exact_avg("value")).alias("latency"))


def error_timeline(errors: DataFrame, every: str = "1 hour") -> DataFrame:
    return errors.groupBy(F.window("ts", every)["start"].alias("time")).agg(F.count("*").alias("count"))


def parse_client(user_agent: Column) -> Column:
    """Struct of browser, os and device by the first mark found."""

    def first(marks, default):
        return F.coalesce(*[F.when(user_agent.contains(mark), F.lit(name)) for mark, name in marks], F.lit(default))

    device = (
        F.when(user_agent.rlike("(?i)Mobi|Android"), F.lit("Mobile"))
        .when(user_agent.rlike("(?i)Tablet|iPad"), F.lit("Tablet"))
        .otherwise(F.lit("Desktop"))
    )
    return F.struct(first(BROWSERS, "Unknown").alias("browser"), first(SYSTEMS, "Unknown").alias("os"), device.alias("device"))


def client_breakdown(errors: DataFrame) -> DataFrame:
    """Count and share per browser, system and device."""
    clients = errors.select(parse_client(F.col("user_agent")).alias("c"))
    counted = clients.groupBy("c").agg(F.count("*").alias("n"))  # a handful of combinations from here on
    sides = F.inline(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col("c")[d].alias("value"), F.col("n")) for d in ("browser", "os", "device")])
    )
    per_value = counted.select(sides).groupBy("dimension", "value").agg(F.sum("n").alias("count"))
    from pyspark.sql import Window

    return per_value.withColumn("share_pct", pct(F.col("count"), F.sum("count").over(Window.partitionBy("dimension"))))


def session_stats(events: DataFrame, user: str = "user_id", gap_seconds: int = 1800, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Sessions, mean duration in seconds and bounce rate; a gap of ``gap_seconds`` starts a new session.

    Everything follows from the distances to the two preceding events, so the
    events of a user are never gathered: durations are the summed inner gaps,
    and a session with more than one event has exactly one second event. One scan
    carries both preceding times.
    """
    rows = events.select(user, "ts", "event_id")
    scanned = previous_two(rows, [user], ["ts", "event_id"], "ts", quantile_blocks(rows, "ts", rows_per_block), "_p1", "_p2")
    gap, before = _gap(F.col("_p1"), F.col("ts")), _gap(F.col("_p2"), F.col("_p1"))
    opens = lambda g, p: p.isNull() | (g >= gap_seconds)
    two = scanned.select(
        gap.alias("_gap"), opens(gap, F.col("_p1")).alias("_start"),
        (F.col("_p1").isNotNull() & opens(before, F.col("_p2"))).alias("_p2"),
    )
    second = ~F.col("_start") & F.col("_p2")
    sums = two.agg(
        F.count_if("_start").alias("total_sessions"),
        F.sum(F.when(~F.col("_start"), F.col("_gap"))).alias("_seconds"),
        F.count_if(second).alias("_longer"),
    )
    total = F.nullif("total_sessions", F.lit(0))
    return sums.select(
        "total_sessions",
        F.coalesce(safe_div(F.coalesce("_seconds", F.lit(0.0)), total), F.lit(0.0)).alias("mean_duration_seconds"),
        pct(F.col("total_sessions") - F.col("_longer"), total).alias("bounce_rate"),
    )


def _gap(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def log_levels_over_time(logs: DataFrame, every: str = "1 hour") -> DataFrame:
    return logs.groupBy(F.window("event_time", every)["start"].alias("time"), "log_level").agg(F.count("*").alias("count"))


def top_error_messages(logs: DataFrame, limit: int = 10) -> DataFrame:
    return (
        logs.where(F.array_contains("tags", "error"))
        .groupBy("message")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "message")
        .limit(limit)
    )


def gdpr_summary(consents: DataFrame, requests: DataFrame, activity: DataFrame) -> DataFrame:
    """Consents given, pending export and deletion requests and activity count per user."""
    kind, pending = F.col("kind"), F.col("status") == "pending"
    parts = [
        consents.groupBy("user_id").agg(F.count_if("granted").alias("consents")),
        requests.groupBy("user_id").agg(
            F.count_if((kind == "export") & pending).alias("pending_exports"),
            F.count_if((kind == "deletion") & pending).alias("pending_deletions"),
        ),
        activity.groupBy("user_id").agg(F.count("*").alias("activity_count")),
    ]
    joined = parts[0].join(parts[1], "user_id", "full").join(parts[2], "user_id", "full")
    return joined.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "user_id"])


def erase_users(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of all users except those with a confirmed deletion."""
    confirmed = requests.where((F.col("kind") == "deletion") & (F.col("status") == "confirmed")).select("user_id").distinct()
    return df.join(confirmed, "user_id", "left_anti")
