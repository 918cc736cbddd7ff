"""Corridor analytics over the payments."""

from pyspark.sql import functions as F

from remitlens.operators import corridors as op
from remitlens.plans.common import AS_OF, AS_OF_SQL
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import PAYMENTS, davg, dsum
from remitlens.sources.tables import payments

_COLS = ("corridor", "source_asset", "dest_asset", "ts", "successful", "latency_ms", "amount_usd", "slippage_bps")

METRICS = f"""m0 AS (
  SELECT corridor, source_asset, dest_asset,
         count(*) AS total_attempts,
         count(*) FILTER (successful) AS successful_payments,
         count(*) FILTER (NOT successful) AS failed_payments,
         round(100.0 * count(*) FILTER (successful) / count(*), 6) AS success_rate,
         {davg('latency_ms')} AS average_latency_ms,
         quantile_cont(latency_ms, 0.5) AS median_latency_ms,
         round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms,
         round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms,
         {dsum('amount_usd')} AS liquidity_depth_usd,
         coalesce(round(CAST(sum(CAST(amount_usd AS DECIMAL(38,12))) FILTER (ts > {AS_OF_SQL} - INTERVAL 24 HOUR AND ts <= {AS_OF_SQL}) AS DOUBLE), 4), 0.0) AS liquidity_volume_24h_usd,
         {davg('slippage_bps')} AS average_slippage_bps,
         max(ts) AS last_updated,
         100.0 * count(*) FILTER (successful) / count(*) AS rate_, sum(latency_ms) / count(*) AS latency_
  FROM payments GROUP BY ALL
), m AS (
  SELECT * EXCLUDE (rate_, latency_), round(0.7 * rate_ + 0.3 * greatest(0.0, 100.0 * (1.0 - latency_ / 5000000.0)), 9) AS health_score
  FROM m0
)"""
_WITH = f"WITH {PAYMENTS}, {METRICS}"


def metrics(spark, sf):
    df = op.corridor_metrics(payments(spark, sf, *_COLS), AS_OF)
    return rounded(
        df, success_rate=6, average_latency_ms=6, p95_latency_ms=6, p99_latency_ms=6, liquidity_depth_usd=4,
        liquidity_volume_24h_usd=4, average_slippage_bps=6, health_score=9,
    )


@query("corridor_metrics", f"{_WITH} SELECT * FROM m")
def corridor_metrics(spark, sf):
    return metrics(spark, sf)


@query(
    "settlement_latency",
    f"""WITH {PAYMENTS} SELECT CAST(ts AS DATE) AS date,
    CAST(floor(quantile_cont(latency_ms, 0.5) + 0.5) AS BIGINT) AS median_ms,
    CAST(floor(quantile_cont(latency_ms, 0.95) + 0.5) AS BIGINT) AS p95_ms,
    CAST(floor(quantile_cont(latency_ms, 0.99) + 0.5) AS BIGINT) AS p99_ms
    FROM payments GROUP BY 1""",
)
def settlement_latency(spark, sf):
    return op.settlement_latency(payments(spark, sf, "ts", "latency_ms"))


@query(
    "settlement_latency_latest",
    f"""WITH {PAYMENTS}, s AS (SELECT CAST(ts AS DATE) AS date,
    CAST(floor(quantile_cont(latency_ms, 0.5) + 0.5) AS BIGINT) AS median_ms,
    CAST(floor(quantile_cont(latency_ms, 0.95) + 0.5) AS BIGINT) AS p95_ms,
    CAST(floor(quantile_cont(latency_ms, 0.99) + 0.5) AS BIGINT) AS p99_ms
    FROM payments GROUP BY 1) SELECT * FROM s WHERE date = (SELECT max(date) FROM s)""",
)
def settlement_latency_latest(spark, sf):
    return op.latest_point(op.settlement_latency(payments(spark, sf, "ts", "latency_ms")))


@query(
    "latency_histogram",
    f"""WITH {PAYMENTS}, b AS (SELECT CASE WHEN latency_ms <= 100 THEN 100 WHEN latency_ms <= 250 THEN 250
      WHEN latency_ms <= 500 THEN 500 WHEN latency_ms <= 1000 THEN 1000 WHEN latency_ms <= 2000 THEN 2000 END AS bucket_ms FROM payments)
    SELECT bucket_ms, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM b), 6) AS percentage
    FROM b GROUP BY bucket_ms""",
)
def latency_histogram(spark, sf):
    return rounded(op.latency_histogram(payments(spark, sf, "latency_ms")), percentage=6)


@query(
    "latency_histogram_wide",
    f"""WITH {PAYMENTS}, b AS (SELECT CASE WHEN latency_ms <= 250000 THEN 250000 WHEN latency_ms <= 500000 THEN 500000
      WHEN latency_ms <= 1000000 THEN 1000000 WHEN latency_ms <= 2000000 THEN 2000000 END AS bucket_ms FROM payments)
    SELECT bucket_ms, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM b), 6) AS percentage
    FROM b GROUP BY bucket_ms""",
)
def latency_histogram_wide(spark, sf):
    edges = [250_000, 500_000, 1_000_000, 2_000_000]
    return rounded(op.latency_histogram(payments(spark, sf, "latency_ms"), edges), percentage=6)


@query(
    "dashboard_kpis",
    f"""{_WITH} SELECT round(avg(coalesce(success_rate, 0)), 1) AS success_rate, count(*) AS active_corridors,
    {dsum('liquidity_volume_24h_usd', 3)} AS total_volume,
    round({davg('average_latency_ms', 9)} / 1000, 2) AS settlement_seconds FROM m""",
)
def dashboard_kpis(spark, sf):
    return rounded(op.dashboard_kpis(metrics(spark, sf)), total_volume=3)


@query(
    "analytics_totals",
    f"""{_WITH} SELECT {dsum('liquidity_volume_24h_usd', 3)} AS total_volume_usd, {davg('success_rate', 4)} AS avg_success_rate,
    count(*) AS active_corridors, CAST(sum(total_attempts) AS BIGINT) AS total_transactions,
    {dsum('liquidity_depth_usd', 3)} AS total_liquidity_usd FROM m""",
)
def analytics_totals(spark, sf):
    return rounded(op.analytics_totals(metrics(spark, sf)), total_volume_usd=3, avg_success_rate=4, total_liquidity_usd=3)


@query(
    "failure_reasons",
    f"""WITH {PAYMENTS} SELECT failure_reason AS reason, count(*) AS count FROM payments WHERE NOT successful
    GROUP BY 1 ORDER BY count DESC, reason LIMIT 10""",
)
def failure_reasons(spark, sf):
    return op.failure_reasons(payments(spark, sf, "successful", "failure_reason"))


@query(
    "recent_failed_corridors",
    f"""WITH {PAYMENTS} SELECT corridor, max(ts) AS last_failure, count(*) AS failures FROM payments WHERE NOT successful
    GROUP BY 1 ORDER BY last_failure DESC, corridor LIMIT 10""",
)
def recent_failed_corridors(spark, sf):
    return op.recent_failed_corridors(payments(spark, sf, "corridor", "ts", "successful"))


_HISTORY = f"""h AS (SELECT corridor, CAST(ts AS DATE) AS date, count(*) AS attempts,
    round(100.0 * count(*) FILTER (successful) / count(*), 6) AS success_rate,
    {dsum('amount_usd')} AS volume_usd, {davg('slippage_bps')} AS average_slippage_bps
    FROM payments GROUP BY 1, 2)"""


def history(spark, sf):
    df = op.corridor_history(payments(spark, sf, "corridor", "ts", "successful", "amount_usd", "slippage_bps"))
    return rounded(df, success_rate=6, volume_usd=4, average_slippage_bps=6)


@query("corridor_history", f"WITH {PAYMENTS}, {_HISTORY} SELECT * FROM h")
def corridor_history(spark, sf):
    return history(spark, sf)


@query(
    "filter_corridors",
    f"""{_WITH} SELECT corridor, success_rate, liquidity_depth_usd FROM m
    WHERE success_rate >= 60 AND (source_asset = 'NATION_1' OR dest_asset = 'NATION_1') AND last_updated >= TIMESTAMP '1998-01-01'""",
)
def filter_corridors(spark, sf):
    from datetime import datetime

    return op.filter_corridors(
        metrics(spark, sf), success_rate_min=60, asset_code="NATION_1", updated_since=datetime(1998, 1, 1)
    ).select("corridor", "success_rate", "liquidity_depth_usd")


@query("search_corridors", f"{_WITH} SELECT corridor, total_attempts FROM m WHERE lower(source_asset) LIKE '%ion_1%' OR lower(dest_asset) LIKE '%ion_1%'")
def search_corridors(spark, sf):
    return op.search(metrics(spark, sf), "ION_1", ["source_asset", "dest_asset"]).select("corridor", "total_attempts")


@query("sort_corridors", f"{_WITH} SELECT corridor, health_score FROM m ORDER BY health_score DESC, corridor")
def sort_corridors(spark, sf):
    return op.sort_corridors(metrics(spark, sf)).select("corridor", "health_score")


@query("top_corridors", f"{_WITH} SELECT corridor, success_rate FROM m ORDER BY success_rate DESC, corridor LIMIT 5")
def top_corridors(spark, sf):
    return op.top_corridors(metrics(spark, sf)).select("corridor", "success_rate")


_UNPIVOT = " UNION ALL ".join(
    f"SELECT corridor, '{m}' AS metric, {m} AS value, {'max' if up else 'min'}({m}) OVER () AS best, "
    f"{'min' if up else 'max'}({m}) OVER () AS worst FROM m"
    for m, up in op.COMPARED_METRICS.items()
)


@query(
    "best_worst",
    f"""{_WITH}, u AS ({_UNPIVOT}), p AS (SELECT *, abs(value - worst) / nullif(abs(best - worst), 0) AS pos FROM u)
    SELECT corridor, metric, value,
      CASE WHEN value = best THEN 'best' WHEN value = worst THEN 'worst' END AS indicator,
      CASE WHEN pos > 0.8 THEN 'high' WHEN pos < 0.3 THEN 'low' ELSE 'stable' END AS trend FROM p""",
)
def best_worst(spark, sf):
    return op.best_worst(metrics(spark, sf))


@query(
    "relative_band",
    f"""{_WITH}, r AS (SELECT corridor, liquidity_depth_usd, liquidity_depth_usd / coalesce(nullif(max(liquidity_depth_usd) OVER (), 0), 1) AS s FROM m)
    SELECT corridor, liquidity_depth_usd, CASE WHEN s >= 0.8 THEN 'top' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'good'
      WHEN s >= 0.2 THEN 'fair' WHEN s >= 0.1 THEN 'low' WHEN s >= 0.05 THEN 'weak' ELSE 'bottom' END AS band FROM r""",
)
def relative_band(spark, sf):
    return op.relative_band(metrics(spark, sf), "liquidity_depth_usd").select("corridor", "liquidity_depth_usd", "band")


@query(
    "corridor_matrix",
    f"""WITH {PAYMENTS}, {_HISTORY}, k AS (SELECT h.*, split_part(corridor, '->', 1) AS source_asset, split_part(corridor, '->', 2) AS dest_asset FROM h)
    SELECT source_asset, dest_asset, max(date) AS date, arg_max(success_rate, date) AS success_rate FROM k GROUP BY 1, 2""",
)
def corridor_matrix(spark, sf):
    parts = F.split("corridor", "->")
    daily = history(spark, sf).withColumns({"source_asset": parts[0], "dest_asset": parts[1]})
    return op.corridor_matrix(daily, "date").select("source_asset", "dest_asset", "date", "success_rate")


@query("distinct_axis", f"WITH {PAYMENTS} SELECT DISTINCT source_asset FROM payments ORDER BY 1")
def distinct_axis(spark, sf):
    return op.distinct_axis(payments(spark, sf, "source_asset"), "source_asset")


_COMPARED = ["NATION_0->NATION_1", "NATION_1->NATION_2", "NATION_2->NATION_3", "NATION_3->NATION_4"]


@query(
    "align_series",
    f"WITH {PAYMENTS}, {_HISTORY} SELECT date, "
    + ", ".join(f"max(success_rate) FILTER (corridor = '{c}') AS c{i}" for i, c in enumerate(_COMPARED))
    + f" FROM h WHERE corridor IN {tuple(_COMPARED)} GROUP BY date",
)
def align_series(spark, sf):
    wide = op.align_series(history(spark, sf), "corridor", _COMPARED, "date", "success_rate")
    return wide.toDF("date", *[f"c{i}" for i in range(len(_COMPARED))])


@query(
    "union_time_axis",
    f"WITH {PAYMENTS}, {_HISTORY} SELECT DISTINCT date FROM h WHERE corridor IN ('{_COMPARED[0]}', '{_COMPARED[1]}')",
)
def union_time_axis(spark, sf):
    daily = history(spark, sf)
    return op.union_time_axis([daily.where(F.col("corridor") == c) for c in _COMPARED[:2]], "date")


@query(
    "related_corridors",
    f"{_WITH} SELECT corridor, success_rate, health_score FROM m WHERE source_asset IN (SELECT source_asset FROM m WHERE corridor = '{_COMPARED[1]}') AND corridor <> '{_COMPARED[1]}'",
)
def related_corridors(spark, sf):
    return op.related_corridors(metrics(spark, sf), _COMPARED[1]).select("corridor", "success_rate", "health_score")


@query(
    "liquidity_trend",
    f"""WITH {PAYMENTS}, {_HISTORY}, f AS (SELECT corridor, regr_slope(volume_usd, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)) / nullif(abs(avg(volume_usd)), 0) AS c FROM h GROUP BY 1)
    SELECT corridor, CASE WHEN c > 0.0005 THEN 'increasing' WHEN c < -0.0005 THEN 'decreasing' ELSE 'stable' END AS trend FROM f""",
)
def liquidity_trend(spark, sf):
    return op.liquidity_trend(history(spark, sf), ["corridor"], "date", "volume_usd")


@query(
    "corridor_labels",
    f"""{_WITH} SELECT corridor,
    CASE WHEN health_score < 70 THEN 'down' WHEN health_score < 90 THEN 'degraded' ELSE 'optimal' END AS status,
    CASE WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 75 THEN 'Good' ELSE 'Needs attention' END AS label,
    CASE WHEN health_score >= 95 THEN 'top' WHEN health_score >= 90 THEN 'high' WHEN health_score >= 85 THEN 'good' WHEN health_score >= 80 THEN 'fair'
         WHEN health_score >= 75 THEN 'low' WHEN health_score >= 70 THEN 'weak' ELSE 'bottom' END AS health_band,
    CASE WHEN success_rate >= 98 THEN 'top' WHEN success_rate >= 95 THEN 'high' WHEN success_rate >= 90 THEN 'good' WHEN success_rate >= 85 THEN 'fair'
         WHEN success_rate >= 80 THEN 'low' WHEN success_rate >= 75 THEN 'weak' ELSE 'bottom' END AS success_band,
    CASE WHEN average_latency_ms <= 1000 THEN 'top' WHEN average_latency_ms <= 2000 THEN 'high' WHEN average_latency_ms <= 3000 THEN 'good'
         WHEN average_latency_ms <= 4000 THEN 'fair' WHEN average_latency_ms <= 5000 THEN 'low' WHEN average_latency_ms <= 8000 THEN 'weak' ELSE 'bottom' END AS latency_band,
    CASE WHEN success_rate < 90 THEN '14:00 UTC' ELSE '08:00 UTC' END AS best_time,
    CASE WHEN success_rate < 90 THEN 'Peak network stability' ELSE 'Lowest historical slippage' END AS best_time_reason FROM m""",
)
def corridor_labels(spark, sf):
    return op.labels(metrics(spark, sf))


@query(
    "comparison_export",
    f"""{_WITH} SELECT source_asset || '-' || dest_asset AS "Corridor", printf('%.2f', round(success_rate, 2)) AS "Success Rate (%)",
    printf('%.1f', round(health_score, 1)) AS "Health Score", printf('%.0f', round(average_latency_ms, 0)) AS "Avg Latency (ms)",
    printf('%.2f', round(liquidity_depth_usd, 2)) AS "Liquidity Depth (USD)", printf('%.2f', round(liquidity_volume_24h_usd, 2)) AS "24h Volume (USD)",
    printf('%.2f', round(average_slippage_bps, 2)) AS "Avg Slippage (bps)", total_attempts AS "Total Attempts", successful_payments AS "Successful", failed_payments AS "Failed" FROM m""",
)
def comparison_export(spark, sf):
    return op.comparison_csv_rows(metrics(spark, sf))
