"""Network-wide daily series, contract activity and ledgers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.numbers import exact_avg, exact_sum, js_round, safe_div


def _date(ts: str = "ts") -> Column:
    return F.to_date(ts).alias("date")


def daily_payment_volume(payments: DataFrame) -> DataFrame:
    return payments.groupBy(_date()).agg(exact_sum("amount_usd").alias("volume"))


def daily_active_accounts(payments: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct accounts on either side of a payment, per day.

    Exact mode first reduces to (day, account), which splits a busy day over its accounts.
    """
    sides = payments.select(_date(), F.explode(F.array("source_account", "dest_account")).alias("account"))
    if approximate:
        return sides.groupBy("date").agg(F.approx_count_distinct("account").alias("active_accounts"))
    return sides.distinct().groupBy("date").agg(F.count("*").alias("active_accounts"))


def transactions_per_day(payments: DataFrame) -> DataFrame:
    return payments.groupBy(_date()).agg(F.count("*").alias("transactions"))


def new_accounts_per_day(payments: DataFrame) -> DataFrame:
    """Accounts by the day they first appear on either side."""
    sides = payments.select("ts", F.explode(F.array("source_account", "dest_account")).alias("account"))
    first = sides.groupBy("account").agg(F.min("ts").alias("first_seen"))
    return first.groupBy(_date("first_seen")).agg(F.count("*").alias("new_accounts"))


def fee_trends(payments: DataFrame) -> DataFrame:
    return payments.groupBy(_date()).agg(exact_avg("fee").alias("average_fee"))


def daily_liquidity(points: DataFrame, value: str = "liquidity_usd") -> DataFrame:
    """Sum over all corridors per date, rounded, in date order."""
    return (
        points.groupBy(_date()).agg(js_round(exact_sum(value)).alias("liquidity_usd")).orderBy("date")
    )


def series_summary(series: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Total, peak, latest, mean and minimum; zeros for an empty series."""
    zero = F.lit(0.0)
    number = F.col(value).cast("double")
    return series.agg(
        F.coalesce(exact_sum(number), zero).alias("total"),
        F.coalesce(F.max(number), zero).alias("peak"),
        F.coalesce(F.max_by(number, F.col(date)), zero).alias("latest"),
        F.coalesce(exact_avg(number), zero).alias("average"),
        F.coalesce(F.min(number), zero).alias("minimum"),
    )


def contract_calls_daily(events: DataFrame) -> DataFrame:
    """Event rows per day, not distinct transactions."""
    return events.groupBy(_date()).agg(F.count("*").alias("calls"))


def top_contracts(events: DataFrame, start: datetime, end: datetime, limit: int = 10) -> DataFrame:
    """Contracts by distinct transactions in a window."""
    return (
        events.where((F.col("ts") > F.lit(start)) & (F.col("ts") <= F.lit(end)))
        .groupBy("contract_id")
        .agg(F.countDistinct("tx_id").alias("calls"), F.count("*").alias("events"), F.max("ts").alias("last_seen"))
        .orderBy(F.desc("calls"), F.desc("events"), "contract_id")
        .limit(limit)
    )


def _two_windows(end: datetime, length: timedelta) -> tuple[Column, Column]:
    ts = F.col("ts")
    middle, start = end - length, end - 2 * length
    return (ts > F.lit(middle)) & (ts <= F.lit(end)), (ts > F.lit(start)) & (ts <= F.lit(middle))


def trend(current: Column, previous: Column) -> Column:
    """Percentage change, null without a previous value."""
    return safe_div(current - previous, F.nullif(previous.cast("double"), F.lit(0.0))) * 100


def direction(change: Column) -> Column:
    return F.when(change > 0, F.lit("up")).when(change < 0, F.lit("down"))


def active_contracts(events: DataFrame, end: datetime, length: timedelta) -> DataFrame:
    """Distinct contracts in the window and the change against the window before."""
    now, before = _two_windows(end, length)
    per_contract = (
        events.where(now | before)
        .groupBy("contract_id")
        .agg(F.max(now).alias("now"), F.max(before).alias("before"))
    )
    counts = per_contract.agg(F.count_if("now").alias("active_contracts"), F.count_if("before").alias("previous_contracts"))
    change = trend(F.col("active_contracts"), F.col("previous_contracts"))
    return counts.select("*", change.alias("trend_pct"), direction(change).alias("direction"))


def gas_usage(events: DataFrame, end: datetime, length: timedelta, gas: str = "gas") -> DataFrame:
    """Total and mean gas of the window and the change of the total."""
    now, before = _two_windows(end, length)
    sums = events.where(now | before).agg(
        F.coalesce(exact_sum(F.when(now, F.col(gas))), F.lit(0.0)).alias("total_gas"),
        exact_avg(F.when(now, F.col(gas))).alias("average_gas"),
        F.coalesce(exact_sum(F.when(before, F.col(gas))), F.lit(0.0)).alias("previous_gas"),
    )
    change = trend(F.col("total_gas"), F.col("previous_gas"))
    return sums.select("*", change.alias("trend_pct"), direction(change).alias("direction"))


def new_deployments(events: DataFrame, limit: int = 10) -> DataFrame:
    """Latest deployments; ``partial`` marks contracts without an init event."""
    deployed = events.groupBy("contract_id").agg(
        F.min(F.when(F.col("kind") == "deploy", F.col("ts"))).alias("deployed_at"),
        (~F.coalesce(F.bool_or(F.col("kind") == "init"), F.lit(False))).alias("partial"),
    )
    return (
        deployed.where(F.col("deployed_at").isNotNull()).orderBy(F.desc("deployed_at"), "contract_id").limit(limit)
    )


def tvl_history(pool_snapshots: DataFrame) -> DataFrame:
    """Value locked per day from the last snapshot of each pool and day."""
    last = pool_snapshots.groupBy("pool", F.to_date("snapshot_at").alias("date")).agg(
        F.max_by("tvl_usd", F.struct("snapshot_at", "tvl_usd")).alias("tvl_usd")
    )
    return last.groupBy("date").agg(exact_sum("tvl_usd").alias("tvl_usd"))


def latest_ledger(operations: DataFrame) -> DataFrame:
    """Highest ledger with its close time, transaction and operation counts."""
    top = operations.agg(F.max("ledger_sequence")).scalar()
    return (
        operations.where(F.col("ledger_sequence") == top)
        .groupBy("ledger_sequence")
        .agg(
            F.max("ts").alias("closed_at"),
            F.countDistinct("tx_id").alias("transaction_count"),
            F.count("*").alias("operation_count"),
        )
    )


def period_trend(series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Change of every point against the point before it in its series."""
    from pyspark.sql import Window

    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    change = trend(F.col(value), F.col("_previous"))
    return series.withColumn("_previous", previous).select(
        *keys, time, value, change.alias("trend_pct"), direction(change).alias("direction")
    )
