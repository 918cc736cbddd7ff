"""Corridor metrics, comparison, history and derived labels."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.operators.scans import exact_percentiles
from remitlens.functions import bands
from remitlens.functions.numbers import exact_avg, exact_sum, js_round, pct, safe_div, to_fixed

# metric -> True when a higher value is better
COMPARED_METRICS = {
    "success_rate": True,
    "health_score": True,
    "average_latency_ms": False,
    "liquidity_depth_usd": True,
    "liquidity_volume_24h_usd": True,
    "average_slippage_bps": False,
}
# Upper bounds in ms of the latency histogram buckets; the last bucket is open.
LATENCY_EDGES = [100, 250, 500, 1000, 2000]


def health_score(success_rate: Column, latency_ms: Column, latency_weight: float = 0.3, ceiling: float = 5_000_000) -> Column:
    """Our default score, since none is defined: success rate blended with relative speed, in [0, 100]."""
    speed = F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - latency_ms / F.lit(float(ceiling))))
    return F.lit(1 - latency_weight) * success_rate + F.lit(latency_weight) * speed


def corridor_metrics(payments: DataFrame, as_of: datetime) -> DataFrame:
    """Attempts, success rate, latency percentiles, volumes and slippage per corridor.

    Sums and counts are one aggregate per corridor, combined map-side. The
    percentiles are exact: a narrow aggregate gives the frequency of each latency,
    and they work on these in blocks, so neither a hot corridor nor a fine-grained
    latency is gathered.
    """
    keys = ["corridor", "source_asset", "dest_asset"]
    recent = (F.col("ts") > F.lit(as_of - timedelta(hours=24))) & (F.col("ts") <= F.lit(as_of))
    total, ok = F.count("*"), F.count_if("successful")
    metrics = payments.groupBy(*keys).agg(
        total.alias("total_attempts"),
        ok.alias("successful_payments"),
        (total - ok).alias("failed_payments"),
        pct(ok, total).alias("success_rate"),
        safe_div(exact_sum("latency_ms"), total).alias("average_latency_ms"),
        exact_sum("amount_usd").alias("liquidity_depth_usd"),
        F.coalesce(exact_sum(F.when(recent, F.col("amount_usd"))), F.lit(0.0)).alias("liquidity_volume_24h_usd"),
        safe_div(exact_sum("slippage_bps"), total).alias("average_slippage_bps"),
        F.max("ts").alias("last_updated"),
    )
    points = {"median_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    placed = exact_percentiles(payments, keys, "latency_ms", points)
    group = F.struct(*keys)  # equal also where a field is null
    placed = placed.select(group.alias("_group"), *points)
    return metrics.withColumn("_group", group).join(placed, "_group", "left").drop("_group").withColumn(
        "health_score", health_score(F.col("success_rate"), F.col("average_latency_ms"))
    )


def settlement_latency(payments: DataFrame, approximate: bool = False) -> DataFrame:
    """Median, p95 and p99 latency per day, rounded to whole milliseconds."""
    points = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    dated = payments.select(F.to_date("ts").alias("date"), "latency_ms")
    if approximate:
        picked = F.percentile_approx("latency_ms", list(points.values()), 10_000)
        daily = dated.groupBy("date").agg(picked.alias("_p")).select("date", *[F.col("_p")[i].alias(n) for i, n in enumerate(points)])
    else:
        daily = exact_percentiles(dated, ["date"], "latency_ms", points)
    return daily.select("date", *[js_round(n).alias(n) for n in points])


def latest_point(series: DataFrame, date: str = "date") -> DataFrame:
    """The newest row of a series."""
    return series.agg(F.max_by(F.struct("*"), date).alias("r")).select("r.*")


def latency_histogram(payments: DataFrame, edges: list[int] | None = None) -> DataFrame:
    """Count and share of payments per latency bucket; an edge is an upper bound."""
    edges = edges or LATENCY_EDGES
    bucket = F.coalesce(*[F.when(F.col("latency_ms") <= e, F.lit(e)) for e in edges])
    counts = payments.groupBy(bucket.alias("bucket_ms")).agg(F.count("*").alias("count"))
    everything = F.sum("count").over(Window.partitionBy())  # one row per bucket at this point
    return counts.withColumn("percentage", pct(F.col("count"), everything))


def dashboard_kpis(corridors: DataFrame) -> DataFrame:
    """Mean success rate (null counts as 0), corridor count, volume and mean settlement seconds."""
    return corridors.agg(
        F.coalesce(F.round(exact_avg(F.coalesce(F.col("success_rate"), F.lit(0.0))), 1), F.lit(0.0)).alias("success_rate"),
        F.count("*").alias("active_corridors"),
        F.coalesce(exact_sum("liquidity_volume_24h_usd"), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.round(exact_avg("average_latency_ms") / 1000, 2), F.lit(0.0)).alias("settlement_seconds"),
    )


def analytics_totals(corridors: DataFrame) -> DataFrame:
    return corridors.agg(
        F.coalesce(exact_sum("liquidity_volume_24h_usd"), F.lit(0.0)).alias("total_volume_usd"),
        F.coalesce(exact_avg("success_rate"), F.lit(0.0)).alias("avg_success_rate"),
        F.count("*").alias("active_corridors"),
        F.coalesce(F.sum("total_attempts"), F.lit(0)).alias("total_transactions"),
        F.coalesce(exact_sum("liquidity_depth_usd"), F.lit(0.0)).alias("total_liquidity_usd"),
    )


def failure_reasons(payments: DataFrame, limit: int | None = 10) -> DataFrame:
    """Failed payments by reason, most frequent first."""
    counts = (
        payments.where(~F.col("successful")).groupBy(F.col("failure_reason").alias("reason")).agg(F.count("*").alias("count"))
    )
    ordered = counts.orderBy(F.desc("count"), "reason")
    return ordered.limit(limit) if limit else ordered


def recent_failed_corridors(payments: DataFrame, limit: int = 10) -> DataFrame:
    """Corridors by their latest failure, newest first."""
    return (
        payments.where(~F.col("successful"))
        .groupBy("corridor")
        .agg(F.max("ts").alias("last_failure"), F.count("*").alias("failures"))
        .orderBy(F.desc("last_failure"), "corridor")
        .limit(limit)
    )


def corridor_history(payments: DataFrame) -> DataFrame:
    """Daily success rate, attempts, volume and slippage of every corridor."""
    return payments.groupBy("corridor", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("attempts"),
        pct(F.count_if("successful"), F.count("*")).alias("success_rate"),
        exact_sum("amount_usd").alias("volume_usd"),
        exact_avg("slippage_bps").alias("average_slippage_bps"),
    )


def filter_corridors(
    corridors: DataFrame,
    success_rate_min: float | None = None,
    success_rate_max: float | None = None,
    volume_min: float | None = None,
    volume_max: float | None = None,
    asset_code: str | None = None,
    updated_since: datetime | None = None,
    sort_by: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """Only the parameters that are given apply; an asset code may match either side."""
    tests = []
    if success_rate_min is not None:
        tests.append(F.col("success_rate") >= success_rate_min)
    if success_rate_max is not None:
        tests.append(F.col("success_rate") <= success_rate_max)
    if volume_min is not None:
        tests.append(F.col("liquidity_volume_24h_usd") >= volume_min)
    if volume_max is not None:
        tests.append(F.col("liquidity_volume_24h_usd") <= volume_max)
    if asset_code:
        tests.append((F.col("source_asset") == asset_code) | (F.col("dest_asset") == asset_code))
    if updated_since is not None:
        tests.append(F.col("last_updated") >= F.lit(updated_since))
    out = corridors.where(reduce(lambda a, b: a & b, tests)) if tests else corridors
    if sort_by:
        out = sort_corridors(out, sort_by)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns; an empty term keeps everything."""
    if not term:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(term.lower()) for c in columns]))


def sort_corridors(corridors: DataFrame, sort_by: str = "health_score") -> DataFrame:
    key = {"success_rate": "success_rate", "liquidity": "liquidity_depth_usd"}.get(sort_by, "health_score")
    return corridors.orderBy(F.desc(key), "corridor")


def top_corridors(corridors: DataFrame, limit: int = 5) -> DataFrame:
    return corridors.orderBy(F.desc("success_rate"), "corridor").limit(limit)


def best_worst(corridors: DataFrame, metrics: dict[str, bool] | None = None) -> DataFrame:
    """Best and worst corridor of each metric and the relative position of the others.

    The extremes are one row per metric, so joining them back needs no shuffle.
    """
    metrics = metrics or COMPARED_METRICS
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = corridors.select("corridor", F.inline(F.array(*pairs)))
    higher = F.col("metric").isin([m for m, up in metrics.items() if up])
    extremes = long.groupBy("metric").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    best, worst = F.when(higher, F.col("hi")).otherwise(F.col("lo")), F.when(higher, F.col("lo")).otherwise(F.col("hi"))
    joined = long.join(F.broadcast(extremes), "metric").withColumns({"best": best, "worst": worst})
    position = safe_div(F.abs(F.col("value") - F.col("worst")), F.abs(F.col("best") - F.col("worst")))
    return joined.select(
        "corridor",
        "metric",
        "value",
        F.when(F.col("value") == F.col("best"), F.lit("best")).when(F.col("value") == F.col("worst"), F.lit("worst")).alias("indicator"),
        F.when(position > 0.8, F.lit("high")).when(position < 0.3, F.lit("low")).otherwise(F.lit("stable")).alias("trend"),
    )


def relative_band(corridors: DataFrame, metric: str, out: str = "band") -> DataFrame:
    """Band of value / maximum; a maximum of 0 counts as 1."""
    top = corridors.agg(F.coalesce(F.nullif(F.max(metric), F.lit(0.0)), F.lit(1.0))).scalar()
    # one column for the share, so that the maximum is looked up once per row and not once per band
    return corridors.withColumn("_share", F.col(metric) / top).withColumn(out, bands.volume_heat(F.col("_share"))).drop("_share")


def corridor_matrix(corridors: DataFrame, order: str) -> DataFrame:
    """One cell per source and destination; the last row by ``order`` wins."""
    return (
        corridors.groupBy("source_asset", "dest_asset")
        .agg(F.max_by(F.struct("*"), F.struct(order, "corridor")).alias("r"))
        .select("r.*")
    )


def distinct_axis(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def align_series(series: DataFrame, key: str, keys: list[str], time: str, value: str) -> DataFrame:
    """One row per time of any series, one column per listed key, null where a series has no point."""
    return series.where(F.col(key).isin(keys)).groupBy(time).pivot(key, keys).agg(F.first(value, ignorenulls=True))


def union_time_axis(series: list[DataFrame], time: str) -> DataFrame:
    """Distinct times of several series."""
    return reduce(lambda a, b: a.union(b), [s.select(time) for s in series]).distinct()


def related_corridors(corridors: DataFrame, corridor: str) -> DataFrame:
    """Other corridors that leave the same source asset; none if the corridor itself has no row."""
    here = corridors.where(F.col("corridor") == corridor).select("source_asset")
    return corridors.where(F.col("corridor") != corridor).join(here, "source_asset", "left_semi")


def liquidity_trend(series: DataFrame, keys: list[str], time: str, value: str, tolerance: float = 0.0005) -> DataFrame:
    """increasing / decreasing when the fitted daily change exceeds ``tolerance`` of the mean (our default)."""
    x = F.unix_date(F.col(time)).cast("double")
    fit = series.groupBy(*keys).agg(F.regr_slope(F.col(value), x).alias("_slope"), exact_avg(value).alias("_mean"))
    change = safe_div(F.col("_slope"), F.abs(F.col("_mean")))
    return fit.select(
        *keys,
        F.when(change > tolerance, F.lit("increasing"))
        .when(change < -tolerance, F.lit("decreasing"))
        .otherwise(F.lit("stable"))
        .alias("trend"),
    )


def comparison_csv_rows(corridors: DataFrame) -> DataFrame:
    """The columns of the corridor comparison export as formatted text."""
    return corridors.select(
        F.concat_ws("-", "source_asset", "dest_asset").alias("Corridor"),
        to_fixed("success_rate", 2).alias("Success Rate (%)"),
        to_fixed("health_score", 1).alias("Health Score"),
        to_fixed("average_latency_ms", 0).alias("Avg Latency (ms)"),
        to_fixed("liquidity_depth_usd", 2).alias("Liquidity Depth (USD)"),
        to_fixed("liquidity_volume_24h_usd", 2).alias("24h Volume (USD)"),
        to_fixed("average_slippage_bps", 2).alias("Avg Slippage (bps)"),
        F.col("total_attempts").alias("Total Attempts"),
        F.col("successful_payments").alias("Successful"),
        F.col("failed_payments").alias("Failed"),
    )


def labels(corridors: DataFrame) -> DataFrame:
    """Status, label, heat bands and recommended time of each corridor."""
    hint = bands.best_time(F.col("success_rate"))
    return corridors.select(
        "corridor",
        bands.health_status(F.col("health_score")).alias("status"),
        bands.health_label(F.col("health_score")).alias("label"),
        bands.health_heat(F.col("health_score")).alias("health_band"),
        bands.success_heat(F.col("success_rate")).alias("success_band"),
        bands.latency_heat(F.col("average_latency_ms")).alias("latency_band"),
        hint["time"].alias("best_time"),
        hint["reason"].alias("best_time_reason"),
    )
