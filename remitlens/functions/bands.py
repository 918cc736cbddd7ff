"""Threshold bands: one lookup list per band scale, one expression builder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band thresholds, highest first. A value belongs to the first
# band whose threshold it reaches.
HEALTH_HEAT = [(95, "top"), (90, "high"), (85, "good"), (80, "fair"), (75, "low"), (70, "weak")]
SUCCESS_HEAT = [(98, "top"), (95, "high"), (90, "good"), (85, "fair"), (80, "low"), (75, "weak")]
VOLUME_HEAT = [(0.8, "top"), (0.6, "high"), (0.4, "good"), (0.2, "fair"), (0.1, "low"), (0.05, "weak")]
# Latency in ms: a value belongs to the first band whose limit it does not exceed.
LATENCY_HEAT = [(1000, "top"), (2000, "high"), (3000, "good"), (4000, "fair"), (5000, "low"), (8000, "weak")]
# Web vitals: (good up to, needs-improvement up to).
WEB_VITALS = {
    "lcp": (2500, 4000),
    "fid": (100, 300),
    "inp": (200, 500),
    "cls": (0.1, 0.25),
    "fcp": (1800, 3000),
    "ttfb": (800, 1800),
}


def at_least(col: Column, steps: list[tuple[float, str]], default: str) -> Column:
    return F.coalesce(*[F.when(col >= F.lit(t), F.lit(name)) for t, name in steps], F.lit(default))


def at_most(col: Column, steps: list[tuple[float, str]], default: str) -> Column:
    return F.coalesce(*[F.when(col <= F.lit(t), F.lit(name)) for t, name in steps], F.lit(default))


def health_status(score: Column) -> Column:
    return at_least(score, [(90, "optimal"), (70, "degraded")], "down")


def health_label(score: Column) -> Column:
    return at_least(score, [(90, "Excellent"), (75, "Good")], "Needs attention")


def health_heat(score: Column) -> Column:
    return at_least(score, HEALTH_HEAT, "bottom")


def success_heat(rate: Column) -> Column:
    return at_least(rate, SUCCESS_HEAT, "bottom")


def volume_heat(share_of_max: Column) -> Column:
    return at_least(share_of_max, VOLUME_HEAT, "bottom")


def latency_heat(ms: Column) -> Column:
    return at_most(ms, LATENCY_HEAT, "bottom")


def link_health_band(health: Column) -> Column:
    return F.when(health.isNull(), F.lit("unknown")).otherwise(
        at_least(health, [(90, "healthy"), (70, "warning")], "critical")
    )


def il_severity(loss: Column) -> Column:
    return F.when(loss < 1, F.lit("low")).when(loss < 5, F.lit("medium")).otherwise(F.lit("high"))


def anchor_tier(uptime: Column) -> Column:
    return at_least(uptime, [(95, "healthy"), (85, "warning")], "critical")


def vital_rating(name: Column, value: Column) -> Column:
    """good / needs-improvement / poor; a vital without thresholds is good."""
    rating = F.lit("good")
    for vital, (good, fair) in WEB_VITALS.items():
        scale = (
            F.when(value <= good, F.lit("good"))
            .when(value <= fair, F.lit("needs-improvement"))
            .otherwise(F.lit("poor"))
        )
        rating = F.when(name == vital, scale).otherwise(rating)
    return rating


def best_time(success_rate: Column) -> Column:
    """Recommended sending hour and the reason, as a struct."""
    weak = success_rate < 90
    return F.struct(
        F.when(weak, F.lit("14:00 UTC")).otherwise(F.lit("08:00 UTC")).alias("time"),
        F.when(weak, F.lit("Peak network stability"))
        .otherwise(F.lit("Lowest historical slippage"))
        .alias("reason"),
    )
