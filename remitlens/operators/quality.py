"""Row-level validation: each rule yields a reason, a row is good when it has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remitlens.errors import MissingNetworkColumn
from remitlens.functions import addresses
from remitlens.functions.times import parse_timestamp

# Fixed values.
NETWORKS = ["mainnet", "testnet", "futurenet"]
ANCHOR_STATUS = ["Red", "Yellow", "Green"]
ANCHOR_SCORES = [
    "reliability_score", "asset_performance_score", "volume_score", "asset_diversity_score", "weighted_success_rate",
]


def _reason(test: Column, code: str, field: str) -> Column:
    return F.when(test, F.lit(f"{code}:{field}"))


def _empty(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def _outside(name: str) -> Column:
    return ~F.col(name).between(0.0, 100.0) | F.isnan(F.col(name).cast("double"))


def with_reasons(df: DataFrame, reasons: list[Column]) -> DataFrame:
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def good(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def quarantined(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0)


def validate_corridors(df: DataFrame) -> DataFrame:
    """Adds ``reasons``: MissingField, InvalidFormat, InvalidAddress or OutOfRange with the field name."""
    checks = [_reason(_empty("corridor_key"), "MissingField", "corridor_key")]
    for side in ("a", "b"):
        code, issuer = f"asset_{side}_code", f"asset_{side}_issuer"
        checks.append(_reason(_empty(code), "MissingField", code))
        checks.append(_reason(~_empty(code) & ~F.length(code).between(1, 12), "InvalidFormat", code))
        checks.append(_reason(~addresses.is_account_address(F.col(issuer)), "InvalidAddress", issuer))
    for score in ("success_rate", "health_score"):
        checks.append(_reason(F.col(score).isNotNull() & _outside(score), "OutOfRange", score))
    if "last_updated" in df.columns and isinstance(df.schema["last_updated"].dataType, T.StringType):
        stamp = F.col("last_updated")
        checks.append(_reason(stamp.isNotNull() & parse_timestamp(stamp).isNull(), "InvalidTimestamp", "last_updated"))
    return with_reasons(df, checks)


def validate_anchors(df: DataFrame) -> DataFrame:
    """Required ids, scores in range, non-negative totals, known status, ISO timestamp, unique id.

    Duplicate ids come from an aggregate joined back, so a heavily repeated id
    is an ordinary (splittable) join key rather than one window partition.
    """
    repeated = df.groupBy("anchor_id").agg((F.count("*") > 1).alias("_repeated"))
    joined = df.join(repeated, "anchor_id", "left")
    checks = [_reason(_empty(f), "MissingField", f) for f in ("anchor_id", "anchor_name")]
    for score in ANCHOR_SCORES:
        checks.append(_reason(F.col(score).isNull(), "MissingField", score))
        checks.append(_reason(_outside(score), "OutOfRange", score))
    for total in ("total_assets", "total_volume_usd"):
        checks.append(_reason(F.col(total).isNull() | (F.col(total) < 0), "OutOfRange", total))
    checks.append(_reason(~F.coalesce(F.col("status").isin(ANCHOR_STATUS), F.lit(False)), "InvalidFormat", "status"))
    checks.append(_reason(parse_timestamp(F.col("timestamp")).isNull(), "InvalidTimestamp", "timestamp"))
    checks.append(_reason(F.coalesce("_repeated", F.lit(False)), "DuplicateAnchorId", "anchor_id"))
    return with_reasons(joined, checks).drop("_repeated")


def require_network_column(tables: dict[str, DataFrame]) -> None:
    """Every table must have a ``network`` column, in any letter case."""
    for name, df in tables.items():
        if "network" not in [c.lower() for c in df.columns]:
            raise MissingNetworkColumn(f"table {name} has no network column")


def network_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, the rows whose network is missing or unknown."""
    require_network_column(tables)
    parts = []
    for name, df in tables.items():
        column = next(c for c in df.columns if c.lower() == "network")
        bad = ~F.coalesce(F.col(column).isin(NETWORKS), F.lit(False))
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.count_if(bad).alias("violations")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_network(df: DataFrame, network: str) -> DataFrame:
    """Rows of one network; on a table partitioned by network this prunes partitions."""
    return df.where(F.col("network") == network)


def validation_health(results: DataFrame, as_of) -> DataFrame:
    """Failures of the last 24 h, last run and pass rate."""
    from datetime import timedelta

    recent = (F.col("validated_at") > F.lit(as_of - timedelta(hours=24))) & (F.col("validated_at") <= F.lit(as_of))
    return results.agg(
        F.count_if(recent & ~F.col("passed")).alias("failed_records_24h"),
        F.max("validated_at").alias("last_validation_run"),
        (F.count_if("passed") * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("validation_pass_rate"),
    )


def reason_counts(validated: DataFrame) -> DataFrame:
    """Quarantined rows per error type."""
    return (
        validated.select(F.explode("reasons").alias("reason"))
        .groupBy(F.split("reason", ":")[0].alias("error_type"))
        .agg(F.count("*").alias("count"))
    )
