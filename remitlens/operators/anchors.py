"""Anchor scores, tiers, asset shares, muxed accounts and the anchor/asset graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitlens.functions import addresses, bands
from remitlens.functions.numbers import exact_avg, exact_sum, pct, round_scaled, safe_div


def settlement_time_score(avg_ms: Column, ceiling_ms: float = 60_000) -> Column:
    """Our default, since no definition exists: 100 at 0 ms, falling linearly to 0 at the ceiling."""
    return F.greatest(F.lit(0.0), F.lit(100.0) * (F.lit(1.0) - avg_ms / F.lit(float(ceiling_ms))))


def reliability_columns(total: Column, successful: Column, score: Column) -> tuple[Column, Column]:
    """(success_rate, reliability_score), both with two decimals, zeros without transactions."""
    rate = round_scaled(pct(successful, F.nullif(total, F.lit(0))), 2)
    return rate, F.when(total == 0, F.lit(0.0)).otherwise(round_scaled(rate * 0.7 + score * 0.3, 2))


def anchor_reliability(anchors: DataFrame, ceiling_ms: float = 60_000) -> DataFrame:
    score = F.coalesce(settlement_time_score(F.col("avg_settlement_time_ms"), ceiling_ms), F.lit(0.0))
    rate, reliability = reliability_columns(F.col("total_transactions"), F.col("successful_transactions"), score)
    return anchors.withColumns({"success_rate": rate, "reliability_score": reliability})


def anchor_composite(anchors: DataFrame, volume_cap: float = 1e9) -> DataFrame:
    """0.6 performance + 0.3 volume (logarithmic up to ``volume_cap``, our default) + 0.1 diversity (10 assets)."""
    volume = F.least(F.lit(100.0), F.log10(F.col("total_volume_usd") + 1.0) / F.log10(F.lit(volume_cap + 1.0)) * 100.0)
    diversity = F.least(F.col("total_assets"), F.lit(10)).cast("double") * 10.0
    composite = F.col("asset_performance_score") * 0.6 + F.col("_volume") * 0.3 + F.col("_diversity") * 0.1
    return (
        anchors.withColumns({"_volume": volume, "_diversity": diversity})
        .withColumn("composite_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), composite)))
        .withColumnsRenamed({"_volume": "volume_score", "_diversity": "asset_diversity_score"})
    )


def anchor_summary(anchors: DataFrame) -> DataFrame:
    healthy = (F.lower("status") == "green") | (F.col("status") == "Healthy")
    return anchors.agg(
        F.count("*").alias("anchors"),
        F.coalesce(F.round(exact_avg("reliability_score"), 1), F.lit(0.0)).alias("average_reliability"),
        F.coalesce(F.sum("total_transactions"), F.lit(0)).alias("total_transactions"),
        F.count_if(healthy).alias("healthy_anchors"),
    )


def anchor_tiers(anchors: DataFrame) -> DataFrame:
    """Anchors per health tier; uptime is the share of successful transactions."""
    uptime = pct(F.col("successful_transactions"), F.nullif("total_transactions", F.lit(0)))
    tier = bands.anchor_tier(uptime)
    return anchors.select(tier.alias("tier")).agg(
        F.count_if(F.col("tier") == "healthy").alias("healthy"),
        F.count_if(F.col("tier") == "warning").alias("warning"),
        F.count_if(F.col("tier") == "critical").alias("critical"),
    )


def reliability_history(payments: DataFrame, ceiling_ms: float = 60_000) -> DataFrame:
    """Daily reliability score per anchor."""
    daily = payments.groupBy("anchor", F.to_date("ts").alias("date")).agg(
        F.count("*").alias("total_transactions"),
        F.count_if("successful").alias("successful_transactions"),
        exact_avg("latency_ms").alias("avg_settlement_time_ms"),
    )
    return anchor_reliability(daily, ceiling_ms).select("anchor", "date", "reliability_score")


def asset_distribution(assets: DataFrame) -> DataFrame:
    """Share of 24 h volume per asset, positive volumes only, largest first."""
    total = assets.agg(exact_sum("volume_24h_usd")).scalar()
    share = F.coalesce(safe_div(F.col("volume_24h_usd"), F.nullif(total, F.lit(0.0))) * 100, F.lit(0.0))
    return (
        assets.withColumn("share_pct", share)
        .where(F.col("volume_24h_usd") > 0)
        .orderBy(F.desc("volume_24h_usd"), "asset_code")
    )


def muxed_usage(payments: DataFrame) -> DataFrame:
    """Payments per muxed address as source, as destination and in total, with the base account.

    Only muxed addresses survive the explode. Counting by address and base
    account first keeps that large aggregate on numeric buffers; the base account
    is picked from the few rows that are left of each address.
    """
    side = F.inline(
        F.array(
            F.struct(F.col("source_address").alias("address"), F.col("source_base").alias("base_account"), F.lit(1).alias("sent"), F.lit(0).alias("received")),
            F.struct(F.col("dest_address").alias("address"), F.col("dest_base").alias("base_account"), F.lit(0).alias("sent"), F.lit(1).alias("received")),
        )
    )
    sides = payments.select(side)
    return (
        sides.where(addresses.is_muxed_address(F.col("address")))
        .groupBy("address", "base_account")
        .agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
        .groupBy("address")
        .agg(
            F.max("base_account").alias("base_account"),
            F.sum("sent").alias("as_source"),
            F.sum("received").alias("as_destination"),
            F.sum(F.col("sent") + F.col("received")).alias("total_payments"),
        )
    )


def muxed_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(
        F.coalesce(F.sum("total_payments"), F.lit(0)).alias("total_muxed_payments"),
        F.count("*").alias("unique_muxed_addresses"),
        F.countDistinct("base_account").alias("base_accounts"),
    )


def top_muxed(usage: DataFrame, limit: int = 10) -> DataFrame:
    return usage.orderBy(F.desc("total_payments"), "address").limit(limit)


def graph_nodes(anchors: DataFrame, corridors: DataFrame) -> DataFrame:
    """Anchor nodes, then asset nodes whose id is not already an anchor id.

    A reliability of 0 or null shows as 50. The first corridor of an asset names it.
    """
    anchor_nodes = anchors.where(
        (F.coalesce("id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    ).select(
        "id",
        "name",
        F.lit("anchor").alias("type"),
        F.coalesce(F.nullif(F.col("reliability_score").cast("double"), F.lit(0.0)), F.lit(50.0)).alias("val"),
        "status",
    )
    asset_nodes = (
        linked(corridors)
        .select(asset_id().alias("id"), "source_asset_code", "source_asset_issuer")
        .distinct()
        .groupBy("id")
        .agg(F.min(F.struct("source_asset_code", "source_asset_issuer")).alias("first"))
        .join(anchor_nodes.select("id"), "id", "left_anti")
        .select(
            "id",
            F.coalesce("first.source_asset_code", F.lit("Unknown")).alias("name"),
            F.lit("asset").alias("type"),
            F.lit(30.0).alias("val"),
            F.col("first.source_asset_issuer").alias("issuer"),
        )
    )
    return anchor_nodes.unionByName(asset_nodes, allowMissingColumns=True)


def graph_links(corridors: DataFrame) -> DataFrame:
    """Two links per corridor that names both anchors: issuance into the asset, corridor out of it."""
    volume = F.coalesce(F.col("volume_usd").cast("double"), F.lit(0.0))
    none = F.lit(None).cast("double")
    links = F.array(
        F.struct(
            F.col("source_anchor_id").alias("source"), asset_id().alias("target"), F.lit("issuance").alias("type"),
            volume.alias("value"), none.alias("health"), none.alias("liquidity"),
        ),
        F.struct(
            asset_id().alias("source"), F.col("destination_anchor_id").alias("target"), F.lit("corridor").alias("type"),
            volume.alias("value"), F.col("success_rate").cast("double").alias("health"),
            F.col("liquidity_score").cast("double").alias("liquidity"),
        ),
    )
    return linked(corridors).select(F.inline(links))


def asset_id() -> Column:
    return F.concat_ws("_", "source_asset_code", "source_asset_issuer")


def linked(corridors: DataFrame) -> DataFrame:
    return corridors.where(
        (F.coalesce("source_anchor_id", F.lit("")) != "") & (F.coalesce("destination_anchor_id", F.lit("")) != "")
    )


def link_health(links: DataFrame) -> DataFrame:
    return links.withColumn("health_band", bands.link_health_band(F.col("health")))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")
