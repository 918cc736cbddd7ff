"""Liquidity pools, trustlines and asset insights."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions import bands
from remitlens.functions.numbers import compact_intl, exact_avg, exact_sum, plain_number, safe_div, to_fixed


def pool_stats(pools: DataFrame) -> DataFrame:
    return pools.agg(
        F.count("*").alias("pools"),
        F.coalesce(exact_sum("tvl_usd"), F.lit(0.0)).alias("tvl_usd"),
        F.coalesce(exact_sum("volume_24h_usd"), F.lit(0.0)).alias("volume_24h_usd"),
        F.coalesce(exact_sum("fees_24h_usd"), F.lit(0.0)).alias("fees_24h_usd"),
        F.coalesce(exact_avg("apy"), F.lit(0.0)).alias("average_apy"),
        F.coalesce(exact_avg("impermanent_loss_pct"), F.lit(0.0)).alias("average_impermanent_loss"),
    )


def pool_severity(pools: DataFrame) -> DataFrame:
    return pools.withColumn("il_severity", bands.il_severity(F.col("impermanent_loss_pct")))


def trustline_stats(assets: DataFrame) -> DataFrame:
    """Assets tracked, trustlines in total and assets that have any. One row per asset comes in."""
    return assets.agg(
        F.count("*").alias("assets_tracked"),
        F.coalesce(F.sum("total_trustlines"), F.lit(0)).alias("total_trustlines"),
        F.count_if(F.col("total_trustlines") > 0).alias("active_assets"),
    )


def trustline_shares(assets: DataFrame) -> DataFrame:
    total = F.nullif("total_trustlines", F.lit(0))
    return assets.select(
        *assets.columns,
        (safe_div(F.col("authorized_trustlines"), total) * 100).alias("authorized_pct"),
        (safe_div(F.col("unauthorized_trustlines"), total) * 100).alias("unauthorized_pct"),
    )


def trustline_rankings(assets: DataFrame, limit: int = 50) -> DataFrame:
    return assets.orderBy(F.desc("total_trustlines"), "asset_code", "asset_issuer").limit(limit)


def asset_insights(transfers: DataFrame, as_of: datetime) -> DataFrame:
    """Concentration, holder growth and transfer volume per asset.

    Transfers are first reduced to one row per asset and holder, so a popular
    asset is spread over its holders before the asset totals are taken.
    """
    since = F.lit(as_of - timedelta(days=30))
    recent = F.col("ts") > since
    holders = (
        transfers.where(F.col("ts") <= F.lit(as_of))
        .groupBy("asset_code", "holder")
        .agg(
            exact_sum("amount_usd").alias("held"),
            exact_sum(F.when(recent, F.col("amount_usd"))).alias("recent"),
            F.min("ts").alias("joined"),
            F.max("ts").alias("last"),
        )
    )
    totals = holders.groupBy("asset_code").agg(
        exact_sum("held").alias("supply"),
        F.max("held").alias("largest"),
        F.count_if(F.col("joined") > since).alias("holder_growth_30d"),
        F.coalesce(exact_sum("recent"), F.lit(0.0)).alias("transfer_volume_30d"),
        F.count("*").alias("total_trustlines"),
        F.min("joined").alias("first"),
    )
    months = F.greatest(F.lit(1.0), F.datediff(F.lit(as_of), "first") / F.lit(30.0))
    return totals.select(
        "asset_code",
        (safe_div(F.col("largest"), F.nullif(F.col("supply").cast("double"), F.lit(0.0))) * 100).alias("largest_holder_pct"),
        "holder_growth_30d",
        "transfer_volume_30d",
        (F.col("supply").cast("double") / months).alias("avg_transfer_volume"),
        "total_trustlines",
    )


def insight_sentences(insights: DataFrame) -> DataFrame:
    """Up to three sentences per asset as an array."""
    return insights.select("asset_code", sentences().alias("sentences"))


# The sentences, each with the limit that its measure is above (or at, where marked) to be said; the first that holds is taken.
_CONCENTRATION = [
    (50.0, "above", "The largest single holder controls %s%% of supply, indicating high concentration."),
    (20.0, "above", "The largest single holder controls %s%% of supply, showing moderate concentration."),
    (float("-inf"), "at", "The largest single holder controls %s%% of supply, suggesting broad distribution."),
]
_FEW_HOLDERS = 50
_SMALL_SAMPLE = "Trustline count changed by %s over 30 days — sample size is small, so trends may not be representative."
_GROWTH = [
    (0.0, "above", "Holder count grew by %s over the past 30 days."),
    (0.0, "at", "Holder count was flat over the past 30 days."),
    (float("-inf"), "at", "Holder count declined by %s over the past 30 days."),
]
_TRANSFERS = [
    (1.2, "above", "30-day transfer volume (%s) is %s%% above the historical average."),
    (0.8, "at", "30-day transfer volume (%s) is in line with the historical average."),
    (float("-inf"), "at", "30-day transfer volume (%s) is %s%% below the historical average."),
]
_TRANSFERS_ALONE = "30-day transfer volume: %s."


def _said(measure: Column, bands: list[tuple[float, str, str]], *values: Column) -> Column:
    """Text of the band of ``measure``, null for a null measure; a text takes as many ``values`` as it has places."""
    texts = [(low, kind, F.format_string(text, *values[: text.count("%s")])) for low, kind, text in bands]
    return F.coalesce(*[F.when(measure > low if kind == "above" else measure >= low, text) for low, kind, text in texts])


def sentences() -> Column:
    """The sentences of one asset: concentration, holders, transfers; what has no measure is left out."""
    share, growth, volume = (F.col(c) for c in ("largest_holder_pct", "holder_growth_30d", "transfer_volume_30d"))
    small = F.coalesce(F.col("total_trustlines") < _FEW_HOLDERS, F.lit(False)) & growth.isNotNull()
    change = F.concat(F.when(growth > 0, F.lit("+")).otherwise(F.lit("")), plain_number(growth))
    # no ratio without a positive average; the plain sentence takes its place
    ratio = safe_div(volume, F.when(F.col("avg_transfer_volume") > 0, F.col("avg_transfer_volume")))
    off = to_fixed(F.abs(ratio - 1) * 100, 0)
    alone = F.when(volume.isNotNull(), F.format_string(_TRANSFERS_ALONE, compact_intl(volume)))
    return F.array_compact(
        F.array(
            _said(share, _CONCENTRATION, to_fixed(share, 1)),
            F.when(small, F.format_string(_SMALL_SAMPLE, change)).otherwise(_said(growth, _GROWTH, plain_number(F.abs(growth)))),
            F.coalesce(_said(ratio, _TRANSFERS, compact_intl(volume), off), alone),
        )
    )
