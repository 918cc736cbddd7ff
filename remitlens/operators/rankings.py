"""Rankings, latest-per-key, last-n and growth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions.numbers import safe_div


def _ranked(df: DataFrame, order: list, limit: int) -> DataFrame:
    """First ``limit`` rows with their rank; only those rows reach the ranking window."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_movers(assets: DataFrame, sort_by: str = "change", limit: int = 10, direction: str | None = None) -> DataFrame:
    """By absolute percentage change (assets without a baseline last) or by volume."""
    if direction == "gainers":
        assets = assets.where(F.col("change_24h_pct") > 0)
    elif direction == "losers":
        assets = assets.where(F.col("change_24h_pct") < 0)
    if sort_by == "volume":
        key = F.desc("volume_24h_usd")
    else:
        key = F.abs("change_24h_pct").desc_nulls_last()
    return _ranked(assets, [key, F.asc("asset_code"), F.asc("asset_issuer")], limit)


def asset_rankings(assets: DataFrame, by: str = "holders", limit: int = 50) -> DataFrame:
    column = {"holders": "holder_count", "volume": "volume_24h_usd"}[by]
    return _ranked(assets, [F.desc(column), F.asc("asset_code"), F.asc("asset_issuer")], limit)


def sortable_top(df: DataFrame, sort_by: str, id_column: str, ascending: bool = False, limit: int = 10) -> DataFrame:
    """Top rows of a sortable table with a total order."""
    key = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
    return df.orderBy(key, F.asc(id_column)).limit(limit)


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Newest n points per key. The limit also runs before the shuffle, so each
    task sends at most n rows of a hot key."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last update of every key, combined map-side."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def current_streak(activity: DataFrame, key: str, as_of: date) -> DataFrame:
    """Consecutive active days ending at ``as_of``; 0 when that day is inactive.

    The streak ends at the newest inactive day, so only gaps between
    consecutive active days are needed.
    """
    days = activity.where((F.col("count") > 0) & (F.col("date") <= F.lit(as_of))).select(key, "date").distinct()
    previous = F.lag("date").over(Window.partitionBy(key).orderBy("date"))
    starts = days.withColumn("_p", previous).where(F.col("_p").isNull() | (F.datediff("date", "_p") > 1))
    last_start = starts.groupBy(key).agg(F.max("date").alias("_start"))
    newest = days.groupBy(key).agg(F.max("date").alias("_newest"))
    everyone = activity.select(key).distinct()
    joined = everyone.join(last_start, key, "left").join(newest, key, "left")
    alive = F.col("_newest") == F.lit(as_of)
    return joined.select(
        key, F.when(alive, F.datediff(F.lit(as_of), "_start") + 1).otherwise(F.lit(0)).cast("bigint").alias("streak")
    )


def growth(series: DataFrame, keys: list[str], time: str, total: str) -> DataFrame:
    """Absolute and percentage growth of the latest point over the earliest one."""
    ends = series.groupBy(*keys).agg(F.min_by(total, time).alias("earliest"), F.max_by(total, time).alias("latest"))
    change = F.col("latest") - F.col("earliest")
    return ends.select(
        "*",
        change.alias("growth"),
        F.when(F.col("earliest") > 0, safe_div(change, F.col("earliest")) * 100).otherwise(F.lit(0.0)).alias("growth_pct"),
    )
