"""Wallet portfolio, allocation, activity, balances and price baselines."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions.numbers import exact_avg, exact_sum, pct, safe_div
from remitlens.functions.times import week_end, week_start


def baseline_24h(prices: DataFrame, keys: list[str], as_of: datetime) -> DataFrame:
    """Latest price and its change against the newest price at least 24 h old.

    One pass: both picks are conditional max_by aggregates over the same rows.
    The change is null when no price is old enough.
    """
    cut = as_of - timedelta(hours=24)
    old = F.col("ts") <= F.lit(cut)
    picked = (
        prices.where(F.col("ts") <= F.lit(as_of))
        .groupBy(*keys)
        .agg(
            F.max_by("price", "ts").alias("price_usd"),
            F.max_by(F.when(old, F.col("price")), F.when(old, F.col("ts"))).alias("price_24h_ago"),
        )
    )
    change = safe_div(F.col("price_usd") - F.col("price_24h_ago"), F.nullif("price_24h_ago", F.lit(0.0))) * 100
    return picked.withColumn("change_24h_pct", change)


def wallet_portfolio(holdings: DataFrame, transfers: DataFrame, prices: DataFrame, as_of: datetime) -> DataFrame:
    """Value, 24 h change, asset count, 30-day transactions and last activity per wallet.

    A holding without a price counts as an asset, adds no value and is reported
    in ``unpriced_count``.
    """
    priced = holdings.join(baseline_24h(prices, ["asset"], as_of), "asset", "left")
    now = F.col("amount") * F.col("price_usd")
    before = F.col("amount") * F.coalesce(F.col("price_24h_ago"), F.col("price_usd"))
    value = priced.groupBy("wallet").agg(
        F.coalesce(exact_sum(now), F.lit(0.0)).alias("total_value_usd"),
        F.coalesce(exact_sum(before), F.lit(0.0)).alias("_before"),
        F.count_if(F.col("amount") > 0).alias("asset_count"),
        F.count_if((F.col("amount") > 0) & F.col("price_usd").isNull()).alias("unpriced_count"),
    )
    recent = (F.col("ts") > F.lit(as_of - timedelta(days=30))) & (F.col("ts") <= F.lit(as_of))
    activity = (
        transfers.where(F.col("ts") <= F.lit(as_of))
        .groupBy("wallet")
        .agg(F.count_if(recent).alias("transactions_30d"), F.max("ts").alias("last_activity"))
    )
    change = F.col("total_value_usd") - F.col("_before")
    return value.join(activity, "wallet", "left").select(
        "wallet",
        "total_value_usd",
        change.alias("change_24h_usd"),
        (safe_div(change, F.nullif("_before", F.lit(0.0))) * 100).alias("change_24h_pct"),
        "asset_count",
        "unpriced_count",
        F.coalesce("transactions_30d", F.lit(0)).alias("transactions_30d"),
        "last_activity",
    )


def wallet_allocation(holdings: DataFrame, value: str = "value_usd") -> DataFrame:
    """Share of each asset in its wallet. Totals are aggregated and joined, so one
    wallet with very many assets does not end up in a single window task."""
    totals = holdings.groupBy("wallet").agg(exact_sum(value).alias("_total"))
    return holdings.join(totals, "wallet").select(
        *holdings.columns, pct(F.col(value), F.nullif("_total", F.lit(0.0))).alias("allocation_pct")
    )


def wallet_activity(transfers: DataFrame) -> DataFrame:
    """Transfers per wallet and day; days without any are absent."""
    return transfers.groupBy("wallet", F.to_date("ts").alias("date")).agg(F.count("*").alias("count"))


def activity_summary(activity: DataFrame, key: str = "wallet") -> DataFrame:
    """Total, active days, mean per active day and the busiest day."""
    busy = F.col("count") > 0
    return activity.groupBy(key).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.count_if(busy).alias("active_days"),
        F.coalesce(F.round(safe_div(F.sum("count"), F.nullif(F.count_if(busy), F.lit(0))), 1), F.lit(0.0)).alias("mean_per_active_day"),
        # one long orders by count, then by the earlier day, and keeps the aggregate hash-based
        F.max_by("date", F.col("count") * 10_000_000 - F.unix_date("date")).alias("busiest_day"),
    )


def densify_daily(activity: DataFrame, keys: list[str], start: date, end: date, count: str = "count") -> DataFrame:
    """A row for every key and day of the range, 0 where nothing happened.

    The day spine is exploded per key, not cross-joined, so every key carries its own calendar.
    """
    spine = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    days = activity.select(*keys).distinct().select(*keys, spine) if keys else None
    if days is None:
        days = activity.sparkSession.range(1).select(spine)
    counted = activity.where(F.col("date").between(F.lit(start), F.lit(end)))
    return days.join(counted, [*keys, "date"], "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def calendar_grid(activity: DataFrame, as_of: date, key: str) -> DataFrame:
    """Activity padded to whole weeks (Sunday to Saturday) with week number and weekday."""
    bounds = activity.groupBy(key).agg(week_start(F.least(F.min("date"), F.lit(as_of))).alias("_first"))
    days = bounds.select(
        key,
        "_first",
        F.explode(F.sequence(F.col("_first"), week_end(F.lit(as_of)))).alias("date"),
    )
    grid = days.join(activity, [key, "date"], "left")
    return grid.select(
        key,
        "date",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.floor(F.datediff("date", "_first") / 7).alias("week"),
        (F.dayofweek("date") - 1).alias("weekday"),
    )


def balance_history(points: DataFrame) -> DataFrame:
    """Total balance per wallet and time over all assets."""
    return points.groupBy("wallet", "ts").agg(exact_sum("balance").alias("total"))


def balance_summary(history: DataFrame) -> DataFrame:
    """Current, mean, highest and lowest total of each wallet."""
    return history.groupBy("wallet").agg(
        F.max_by("total", "ts").alias("current"),
        exact_avg("total").alias("average"),
        F.max("total").alias("highest"),
        F.min("total").alias("lowest"),
    )


def largest_transfers(transfers: DataFrame, limit: int, per_wallet: bool = True) -> DataFrame:
    """Largest transfers by amount with a total order; per wallet or overall."""
    order = [F.desc("amount_usd"), F.desc("ts"), F.asc("payment_id")]
    if not per_wallet:
        return transfers.orderBy(*order).limit(limit)
    window = Window.partitionBy("wallet").orderBy(*order)
    return transfers.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= limit).drop("_rn")
