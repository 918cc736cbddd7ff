"""Reconciliation of off-chain aggregates with on-chain records, and metric regressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.functions.numbers import safe_div

# Discrepancy details.
DETAILS = {
    "MissingOnChain": "off-chain aggregate exists but on-chain snapshot is missing",
    "MissingOffChain": "on-chain snapshot exists but off-chain aggregate is missing",
    "SnapshotHashMismatch": "snapshot hash mismatch",
    "SourceDataHashMismatch": "source data hash mismatch",
}


def _side(df: DataFrame, prefix: str) -> DataFrame:
    """One side with its columns renamed; ``own_period`` is the period its record states."""
    own = "record_period" if "record_period" in df.columns else "period"
    return df.select(
        "period",
        F.col(own).alias(f"{prefix}_period"),
        F.col("snapshot_hash").alias(f"{prefix}_snapshot"),
        F.col("source_data_hash").alias(f"{prefix}_source"),
    )


def reconcile(periods: DataFrame, offchain: DataFrame, onchain: DataFrame) -> DataFrame:
    """Discrepancies (period, kind, detail) of the listed periods. Every one is alert-worthy.

    Three inputs joined on ``period``: one shuffle each, no per-period lookups.
    """
    joined = (
        periods.select("period").distinct().join(_side(offchain, "off"), "period", "left").join(_side(onchain, "on"), "period", "left")
    )
    off, on = F.col("off_period").isNotNull(), F.col("on_period").isNotNull()

    def found(test, kind, detail=None):
        return F.when(test, F.struct(F.lit(kind).alias("kind"), (detail if detail is not None else F.lit(DETAILS[kind])).alias("detail")))

    both = off & on
    kinds = F.array_compact(
        F.array(
            found(off & ~on, "MissingOnChain"),
            found(~off & on, "MissingOffChain"),
            found(
                both & (F.col("off_period") != F.col("on_period")),
                "EpochMismatch",
                F.concat(F.lit("period mismatch: off-chain="), F.col("off_period").cast("string"), F.lit(", on-chain="), F.col("on_period").cast("string")),
            ),
            found(both & ~F.col("off_snapshot").eqNullSafe(F.col("on_snapshot")), "SnapshotHashMismatch"),
            found(both & ~F.col("off_source").eqNullSafe(F.col("on_source")), "SourceDataHashMismatch"),
        )
    )
    return joined.select("period", F.inline(kinds))


def discrepancy_alerts(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.select(
        F.lit("DiscrepancyDetected").alias("kind"),
        F.lit("Warning").alias("severity"),
        "period",
        F.col("detail").alias("message"),
    )


def missing_submissions(periods: DataFrame, offchain: DataFrame, onchain: DataFrame) -> DataFrame:
    """Listed periods that have an aggregate but no on-chain snapshot."""
    wanted = periods.select("period").distinct()
    return wanted.join(offchain.select("period"), "period", "left_semi").join(onchain.select("period"), "period", "left_anti")


def resubmit(
    periods: DataFrame, offchain: DataFrame, onchain: DataFrame, submit: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(attempts, on-chain records after resubmission).

    ``submit`` takes the missing aggregates and returns (period, error), error
    null on success. Its result must be stored by the writer, since it is read twice.
    """
    missing = offchain.join(missing_submissions(periods, offchain, onchain), "period", "left_semi")
    attempts = submit(missing).select("period", "error")
    stored = missing.join(attempts.where(F.col("error").isNull()), "period", "left_semi")
    return attempts, onchain.unionByName(stored.select(*[c for c in onchain.columns]), allowMissingColumns=True)


def resubmission_alerts(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("error").isNotNull()).select(
        F.lit("MissingSubmissionResubmitFailed").alias("kind"),
        F.lit("Critical").alias("severity"),
        "period",
        F.concat(F.lit("automatic resubmission failed for missing on-chain snapshot: "), F.col("error")).alias("message"),
    )


def reconciliation_report(periods: DataFrame, discrepancies: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row of counts. Each input shrinks to one row before they meet."""
    checked = periods.agg(F.countDistinct("period")).scalar()
    found = discrepancies.agg(F.count("*")).scalar()
    return attempts.agg(
        checked.alias("checked_periods"),
        found.alias("discrepancies"),
        F.count("*").alias("missing_periods"),
        F.count("*").alias("attempts"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
    )


def check_regression(current: DataFrame, baseline: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Cost metrics: NEW without a baseline, FAIL above the threshold, else OK."""
    joined = current.join(baseline.withColumnRenamed("value", "baseline"), "name", "left")
    change = safe_div(F.col("value") - F.col("baseline"), F.nullif("baseline", F.lit(0.0)))
    return joined.withColumn("change", change).withColumn(
        "status",
        F.when(F.col("baseline").isNull(), F.lit("NEW")).when(F.col("change") > threshold, F.lit("FAIL")).otherwise(F.lit("OK")),
    )


def check_throughput(current: DataFrame, baseline: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """Rates: MISSING_BASELINE without a positive baseline, REGRESSION below the threshold, else OK."""
    joined = current.join(baseline.withColumnRenamed("value", "baseline"), "name", "left")
    usable = F.coalesce((F.col("baseline") > 0) & ~F.isnan("baseline"), F.lit(False))
    change = F.when(usable, safe_div(F.col("value") - F.col("baseline"), F.col("baseline")) * 100)
    return joined.withColumn("change_pct", change).withColumn(
        "status",
        F.when(~usable, F.lit("MISSING_BASELINE"))
        .when(F.col("change_pct") < -threshold_pct, F.lit("REGRESSION"))
        .otherwise(F.lit("OK")),
    )
