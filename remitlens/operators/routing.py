"""Success prediction by rule, currency conversion, route costs and generated insights."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.functions.numbers import safe_div, to_fixed

# Base probability of the common pairs, and the recommendation per risk level.
BASE_PROBABILITY = {
    "USDC-XLM": 0.95, "USDC-EURC": 0.92, "XLM-USDC": 0.94, "USDC-PHP": 0.88, "USDC-NGN": 0.82, "EUR-USD": 0.91,
}
RECOMMENDATIONS = {
    "low": "High probability of success. Proceed with payment.",
    "medium": "Moderate success rate. Consider splitting into smaller amounts or adjusting timing.",
    "high": "Risk of failure is elevated. Consider alternative corridors or waiting for better conditions.",
}
VIA_USDC_RATE, VIA_XLM_GAIN = 0.96, 0.03


def predict_success(requests: DataFrame, unknown_pair: float = 0.8) -> DataFrame:
    """Rule score of (source_asset, dest_asset, amount, hour).

    An unlisted pair has no defined base probability; ``unknown_pair`` is ours.
    """
    pair = F.concat_ws("-", "source_asset", "dest_asset")
    base = F.coalesce(*[F.when(pair == k, F.lit(v)) for k, v in BASE_PROBABILITY.items()], F.lit(unknown_pair))
    size = F.greatest(F.lit(0.85), F.lit(1.0) - F.col("amount") / 100000 * 0.1)
    hour = F.when(F.col("hour").between(9, 17), F.lit(1.02)).otherwise(F.lit(0.98))
    scored = requests.withColumn("success_probability", F.least(F.lit(0.99), base * size * hour))
    p = F.col("success_probability")
    spread = (F.lit(1.0) - p) * 0.3 + 0.02
    risk = F.when(p >= 0.85, F.lit("low")).when(p >= 0.65, F.lit("medium")).otherwise(F.lit("high"))
    return scored.withColumns(
        {
            "lower_bound": F.greatest(F.lit(0.0), p - spread),
            "upper_bound": F.least(F.lit(1.0), p + spread / 2),
            "risk_level": risk,
            "alternative_routes": alternatives(p),
        }
    ).withColumn(
        "recommendation", F.coalesce(*[F.when(F.col("risk_level") == k, F.lit(v)) for k, v in RECOMMENDATIONS.items()])
    )


def alternatives(p: Column) -> Column:
    """Routes that promise more than the direct one."""
    routes = F.array(
        F.struct(F.lit("XLM").alias("via_asset"), F.least(F.lit(0.99), p + VIA_XLM_GAIN).alias("estimated_success_rate")),
        F.struct(F.lit("USDC").alias("via_asset"), F.lit(VIA_USDC_RATE).alias("estimated_success_rate")),
    )
    return F.filter(routes, lambda r: r["estimated_success_rate"] > p)


def model_interval(p: Column, confidence: Column) -> Column:
    """Interval around a served model's probability."""
    spread = (F.lit(1.0) - confidence) * 0.2
    return F.struct(
        F.greatest(F.lit(0.0), p - spread).alias("lower_bound"), F.least(F.lit(1.0), p + spread / 2).alias("upper_bound")
    )


def convert(amounts: DataFrame, prices: DataFrame) -> DataFrame:
    """Amount in the destination asset at the cross rate of the two USD prices; null without a price."""
    usd = prices.select("asset", "price_usd")
    source = usd.withColumnsRenamed({"asset": "from_asset", "price_usd": "_source_usd"})
    dest = usd.withColumnsRenamed({"asset": "to_asset", "price_usd": "_dest_usd"})
    rate = safe_div(F.col("_source_usd"), F.nullif("_dest_usd", F.lit(0.0)))
    return (
        amounts.join(source, "from_asset", "left")
        .join(dest, "to_asset", "left")
        .withColumn("rate", rate)
        .withColumn("converted_amount", F.col("amount") * F.col("rate"))
        .drop("_source_usd", "_dest_usd")
    )


def with_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach the routes on offer to each request as one array.

    ``routes`` is a price list of a few routes per set:
    route_set, route, spread_bps, service_bps, slippage_bps, network_fee. A request
    names its ``route_set``. With the list in the row, costing and choosing a
    route need no further shuffle.
    """
    fields = ["route", "spread_bps", "service_bps", "slippage_bps", "network_fee"]
    offered = routes.groupBy("route_set").agg(F.collect_list(F.struct(*fields)).alias("_routes"))
    return requests.join(offered, "route_set")


def _cost(route: Column) -> Column:
    """Cost breakdown of one route; total and name come first, so structs order by them."""
    amount, mid, wanted = F.col("source_amount"), F.col("mid_market_rate"), F.col("destination_amount")
    spread = amount * route["spread_bps"] / 10000
    service = amount * route["service_bps"] / 10000
    slippage = amount * route["slippage_bps"] / 10000
    fees = spread + service + route["network_fee"] + slippage
    arrives = (amount - fees) * mid
    short = F.when(wanted.isNotNull(), F.greatest(F.lit(0.0), wanted - arrives))
    rate = safe_div(arrives, F.nullif(amount, F.lit(0.0)))
    return F.struct(
        fees.alias("total_fees_source"),
        route["route"].alias("route"),
        spread.alias("spread_cost_source"),
        service.alias("service_fee_source"),
        route["network_fee"].alias("network_fee_source"),
        slippage.alias("slippage_cost_source"),
        (fees * mid).alias("total_fees_destination"),
        arrives.alias("estimated_destination_amount"),
        rate.alias("effective_rate"),
        short.alias("destination_shortfall"),
        safe_div(short, F.nullif(rate, F.lit(0.0))).alias("additional_source_required"),
    )


def route_costs(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per request and route with its cost breakdown and rank by total cost."""
    costs = F.array_sort(F.transform("_routes", _cost))
    priced = with_routes(requests, routes)
    kept = [c for c in priced.columns if c != "_routes"]
    return priced.select(*kept, F.posexplode(costs).alias("_rank", "_cost")).select(
        *kept, (F.col("_rank") + 1).alias("rank"), "_cost.*"
    )


def best_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Cheapest route per request, ties by name: the smallest struct of the row's own array."""
    priced = with_routes(requests, routes)
    kept = [c for c in priced.columns if c != "_routes"]
    return priced.select(*kept, F.array_min(F.transform("_routes", _cost)).alias("_cost")).select(*kept, "_cost.*")


def _last_days(df: DataFrame, as_of, days: int) -> DataFrame:
    """Rows of the last days up to ``as_of``; plain bounds on the date, which go below a grouping by date."""
    last = as_of.date()
    return df.where(F.col("date").between(F.lit(last - timedelta(days=days - 1)), F.lit(last)))


def corridor_insights(history: DataFrame, as_of, weak_rate: float = 95.0) -> DataFrame:
    """Sentences on each corridor's rate change this week against the week before."""
    day = F.lit(as_of.date())
    age = F.datediff(day, "date")
    week = _last_days(history, as_of, 14).groupBy("corridor").agg(
        F.sum(F.when(age < 7, F.col("successes"))).alias("_ok1"), F.sum(F.when(age < 7, F.col("attempts"))).alias("_n1"),
        F.sum(F.when(age >= 7, F.col("successes"))).alias("_ok0"), F.sum(F.when(age >= 7, F.col("attempts"))).alias("_n0"),
    )
    now = safe_div(F.col("_ok1"), F.col("_n1")) * 100
    before = safe_div(F.col("_ok0"), F.col("_n0")) * 100
    rated = week.select("corridor", now.alias("rate"), (now - before).alias("change"))
    verb = F.when(F.col("change") > 0, F.lit("improved ")).when(F.col("change") < 0, F.lit("dropped ")).otherwise(F.lit("changed "))
    sentence = F.when(
        F.col("change").isNotNull(),
        F.concat(F.col("corridor"), F.lit(" success rate "), verb, to_fixed(F.abs("change"), 1), F.lit("% this week")),
    )
    return rated.select("corridor", "rate", "change", (F.col("rate") < weak_rate).alias("below_target"), sentence.alias("sentence"))


def weak_corridor_sentence(insights: DataFrame, weak_rate: float = 95.0) -> DataFrame:
    count = F.count_if("below_target")
    return insights.agg(
        F.concat(count.cast("string"), F.lit(f" corridors dropped below {weak_rate:g}% uptime")).alias("sentence")
    )


def anchor_insights(daily: DataFrame, as_of) -> DataFrame:
    """Sentences on each anchor's reliability change this week and its newly supported assets.

    ``daily`` has (anchor, date, attempts, successes, new_assets), one row per anchor and day.
    """
    age = F.datediff(F.lit(as_of.date()), "date")
    sums = _last_days(daily, as_of, 14).groupBy("anchor").agg(
        F.sum(F.when(age < 7, F.col("successes"))).alias("_ok1"), F.sum(F.when(age < 7, F.col("attempts"))).alias("_n1"),
        F.sum(F.when(age >= 7, F.col("successes"))).alias("_ok0"), F.sum(F.when(age >= 7, F.col("attempts"))).alias("_n0"),
        F.coalesce(F.sum(F.when(age < 7, F.col("new_assets"))), F.lit(0)).alias("new_assets"),
    )
    change = safe_div(F.col("_ok1"), F.col("_n1")) * 100 - safe_div(F.col("_ok0"), F.col("_n0")) * 100
    rated = sums.select("anchor", change.alias("change"), "new_assets")
    verb = F.when(F.col("change") > 0, F.lit("rose ")).when(F.col("change") < 0, F.lit("dropped ")).otherwise(F.lit("changed "))
    reliability = F.when(
        F.col("change").isNotNull(),
        F.concat(F.col("anchor"), F.lit(" reliability "), verb, to_fixed(F.abs("change"), 1), F.lit("% this week")),
    )
    assets = F.when(
        F.col("new_assets") > 0, F.concat(F.col("anchor"), F.lit(" now supports "), F.col("new_assets").cast("string"), F.lit(" new assets"))
    )
    return rated.select("anchor", "change", "new_assets", F.array_join(F.array_compact(F.array(reliability, assets)), "; ").alias("sentence"))


def governance_insights(counts: DataFrame, eligible: int) -> DataFrame:
    """Momentum and turnout sentence of each proposal from its vote counts."""
    total = F.col("votes_for") + F.col("votes_against") + F.col("votes_abstain")
    support = safe_div(F.col("votes_for"), F.nullif(total, F.lit(0))) * 100
    turnout = safe_div(F.col("voters"), F.lit(eligible)) * 100
    return counts.select(
        "proposal_id",
        F.concat(
            F.lit("Proposal "), F.col("proposal_id").cast("string"), F.lit(" has "), to_fixed(F.coalesce(support, F.lit(0.0)), 1),
            F.lit("% support at "), to_fixed(turnout, 1), F.lit("% turnout"),
        ).alias("sentence"),
    )
