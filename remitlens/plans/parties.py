"""Anchors, wallets, pools, trustlines, governance and quests over the supplied tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from remitlens.functions.numbers import exact_avg, exact_sum
from remitlens.operators import anchors as anc
from remitlens.operators import governance as gov
from remitlens.operators import network, paging, pools, rankings, wallets
from remitlens.plans.common import AS_OF, AS_OF_SQL
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import EVENTS, PAYMENTS, davg, dsum
from remitlens.sources.tables import events, payments, table

CEILING = 5_000_000

# ---- anchors -------------------------------------------------------------------------------------

ANCHORS = f"""a0 AS (SELECT s_suppkey, s_name FROM supplier),
  a1 AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok,
      sum(abs(date_diff('day', o_orderdate, l_shipdate)) * 1000) / count(*) AS ms, {dsum('l_extendedprice * (1 - l_discount)')} AS vol,
      count(DISTINCT l_partkey) AS assets FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  a2 AS (SELECT s_suppkey::VARCHAR AS anchor_id, s_name AS name, coalesce(n, 0) AS total_transactions, coalesce(ok, 0) AS successful_transactions,
      ms, coalesce(vol, 0.0) AS total_volume_usd, coalesce(assets, 0) AS total_assets FROM a0 LEFT JOIN a1 ON s_suppkey = l_suppkey),
  a3 AS (SELECT *, coalesce(round(100.0 * successful_transactions / nullif(total_transactions, 0), 2), 0.0) AS success_rate FROM a2),
  anchors AS (SELECT anchor_id, name, total_transactions, successful_transactions, total_volume_usd, total_assets, success_rate,
      CASE WHEN total_transactions = 0 THEN 0.0 ELSE round(success_rate * 0.7 + coalesce(greatest(0.0, 100.0 * (1.0 - ms / {CEILING}.0)), 0.0) * 0.3, 2) END AS reliability_score,
      round(100.0 - success_rate, 2) AS failure_rate,
      CASE WHEN success_rate >= 67 THEN 'Green' WHEN success_rate >= 65 THEN 'Yellow' ELSE 'Red' END AS status FROM a3)"""


def anchor_frame(spark, sf):
    per = (
        payments(spark, sf, "dest_account", "successful", "latency_ms", "amount_usd")
        .join(table(spark, sf, "supplier").selectExpr("s_suppkey AS dest_account", "s_name AS name"), "dest_account", "right")
    )
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("dest_account")).agg(
        F.countDistinct("l_partkey").alias("total_assets")
    )
    base = (
        per.groupBy("dest_account", "name")
        .agg(
            F.count("amount_usd").alias("total_transactions"),
            F.count_if("successful").alias("successful_transactions"),
            exact_avg("latency_ms").alias("avg_settlement_time_ms"),
            F.coalesce(exact_sum("amount_usd"), F.lit(0.0)).alias("total_volume_usd"),
        )
        .join(parts, "dest_account", "left")
    )
    scored = anc.anchor_reliability(base, CEILING)
    status = F.when(F.col("success_rate") >= 67, "Green").when(F.col("success_rate") >= 65, "Yellow").otherwise("Red")
    return scored.select(
        F.col("dest_account").cast("string").alias("anchor_id"),
        "name",
        "total_transactions",
        "successful_transactions",
        F.round("total_volume_usd", 4).alias("total_volume_usd"),
        F.coalesce("total_assets", F.lit(0)).alias("total_assets"),
        "success_rate",
        "reliability_score",
        F.round(100.0 - F.col("success_rate"), 2).alias("failure_rate"),
        status.alias("status"),
    )


_A = f"WITH {ANCHORS}"


@query("anchor_reliability", f"{_A} SELECT * FROM anchors")
def anchor_reliability(spark, sf):
    return anchor_frame(spark, sf)


@query(
    "anchor_composite",
    f"""{_A}, s AS (SELECT anchor_id, success_rate AS asset_performance_score,
      least(100.0, log10(total_volume_usd + 1.0) / log10(1000000001.0) * 100.0) AS v, least(total_assets, 10) * 10.0 AS d FROM anchors)
    SELECT anchor_id, round(v, 6) AS volume_score, d::DOUBLE AS asset_diversity_score,
      round(least(100.0, greatest(0.0, asset_performance_score * 0.6 + v * 0.3 + d * 0.1)), 6)::DOUBLE AS composite_score FROM s""",
)
def anchor_composite(spark, sf):
    scored = anc.anchor_composite(anchor_frame(spark, sf).withColumnRenamed("success_rate", "asset_performance_score"))
    return rounded(scored, volume_score=6, composite_score=6).select(
        "anchor_id", "volume_score", "asset_diversity_score", "composite_score"
    )


@query(
    "anchor_summary",
    f"""{_A} SELECT count(*) AS anchors, round({davg('reliability_score', 9)}, 1) AS average_reliability, CAST(sum(total_transactions) AS BIGINT) AS total_transactions,
    count(*) FILTER (lower(status) = 'green' OR status = 'Healthy') AS healthy_anchors FROM anchors""",
)
def anchor_summary(spark, sf):
    return anc.anchor_summary(anchor_frame(spark, sf))


@query(
    "anchor_tiers",
    f"""{_A}, u AS (SELECT coalesce(100.0 * successful_transactions / nullif(total_transactions, 0), 0) AS up FROM anchors)
    SELECT count(*) FILTER (up >= 95) AS healthy, count(*) FILTER (up >= 85 AND up < 95) AS warning, count(*) FILTER (up < 85) AS critical FROM u""",
)
def anchor_tiers(spark, sf):
    return anc.anchor_tiers(anchor_frame(spark, sf))


@query(
    "anchor_reliability_history",
    f"""WITH {PAYMENTS}, d AS (SELECT anchor, CAST(ts AS DATE) AS date, round(100.0 * count(*) FILTER (successful) / count(*), 2) AS r, sum(latency_ms) / count(*) AS ms FROM payments GROUP BY 1, 2)
    SELECT anchor, date, round(r * 0.7 + greatest(0.0, 100.0 * (1.0 - ms / {CEILING}.0)) * 0.3, 2) AS reliability_score FROM d""",
)
def anchor_reliability_history(spark, sf):
    return anc.reliability_history(payments(spark, sf, "anchor", "ts", "successful", "latency_ms"), CEILING)


@query("sort_anchors_failure_rate", f"{_A} SELECT anchor_id, failure_rate FROM anchors ORDER BY failure_rate, anchor_id")
def sort_anchors_failure_rate(spark, sf):
    return paging.sort_anchors(anchor_frame(spark, sf), "failure_rate").select("anchor_id", "failure_rate")


@query("sort_anchor_table_name", f"{_A} SELECT anchor_id, name FROM anchors ORDER BY lower(name) DESC, anchor_id")
def sort_anchor_table_name(spark, sf):
    return paging.sort_anchor_table(anchor_frame(spark, sf), "name").select("anchor_id", "name")


@query(
    "asset_distribution",
    f"""WITH s AS (SELECT p_brand AS asset_code, coalesce(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(38,12))) FILTER (l_returnflag = 'N') AS DOUBLE), 4), 0.0) AS volume_24h_usd
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT *, round(100.0 * volume_24h_usd / (SELECT sum(volume_24h_usd) FROM s), 6) AS share_pct FROM s WHERE volume_24h_usd > 0 ORDER BY volume_24h_usd DESC, asset_code""",
)
def asset_distribution(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    volumes = (
        table(spark, sf, "lineitem")
        .join(part, F.expr("l_partkey = p_partkey"))
        .groupBy(F.col("p_brand").alias("asset_code"))
        .agg(F.coalesce(F.round(exact_sum(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))), 4), F.lit(0.0)).alias("volume_24h_usd"))
    )
    return rounded(anc.asset_distribution(volumes), share_pct=6)


# Muxed addresses: machinery customers pay through a muxed address of their nation's base account.
_MUXED = """WITH p AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'M' || lpad(c_custkey::VARCHAR, 68, '0') ELSE 'G' || lpad(c_custkey::VARCHAR, 55, '0') END AS src,
    'G' || lpad(c_nationkey::VARCHAR, 55, '0') AS src_base, 'M' || lpad(l_suppkey::VARCHAR, 68, '0') AS dst, 'G' || lpad('9', 55, '0') AS dst_base
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  sides AS (SELECT src AS address, src_base AS base_account, 1 AS s FROM p UNION ALL SELECT dst, dst_base, 0 FROM p),
  u AS (SELECT address, max(base_account) AS base_account, count(*) FILTER (s = 1) AS as_source, count(*) FILTER (s = 0) AS as_destination, count(*) AS total_payments
    FROM sides WHERE address LIKE 'M%' GROUP BY 1)"""


def muxed_payments(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    g = lambda c: F.concat(F.lit("G"), F.lpad(c.cast("string"), 55, "0"))
    m = lambda c: F.concat(F.lit("M"), F.lpad(c.cast("string"), 68, "0"))
    return payments(spark, sf, "source_account", "dest_account").join(customer, F.expr("source_account = c_custkey")).select(
        F.when(F.col("c_mktsegment") == "MACHINERY", m(F.col("c_custkey"))).otherwise(g(F.col("c_custkey"))).alias("source_address"),
        g(F.col("c_nationkey")).alias("source_base"),
        m(F.col("dest_account")).alias("dest_address"),
        g(F.lit(9)).alias("dest_base"),
    )


@query("muxed_usage", f"{_MUXED} SELECT * FROM u")
def muxed_usage(spark, sf):
    return anc.muxed_usage(muxed_payments(spark, sf))


@query("muxed_totals", f"{_MUXED} SELECT CAST(sum(total_payments) AS BIGINT) AS total_muxed_payments, count(*) AS unique_muxed_addresses, count(DISTINCT base_account) AS base_accounts FROM u")
def muxed_totals(spark, sf):
    return anc.muxed_totals(anc.muxed_usage(muxed_payments(spark, sf)))


@query("top_muxed", f"{_MUXED} SELECT * FROM u ORDER BY total_payments DESC, address LIMIT 10")
def top_muxed(spark, sf):
    return anc.top_muxed(anc.muxed_usage(muxed_payments(spark, sf)))


# Graph corridors: supplier to customer nation, per part type.
_GRAPH = f"""{_A}, g AS (SELECT l_suppkey::VARCHAR AS sa, CASE WHEN c_nationkey < 24 THEN c_nationkey::VARCHAR END AS da, p_brand AS code, p_type AS issuer,
      {dsum('l_extendedprice')} AS volume_usd, round(100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*), 6) AS success_rate, max(p_size)::DOUBLE AS liquidity_score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


def graph_corridors(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = (
        lines.join(orders, F.expr("l_orderkey = o_orderkey"))
        .join(customer, F.expr("o_custkey = c_custkey"))
        .join(part, F.expr("l_partkey = p_partkey"))
    )
    return joined.groupBy(
        F.col("l_suppkey").cast("string").alias("source_anchor_id"),
        F.when(F.col("c_nationkey") < 24, F.col("c_nationkey").cast("string")).alias("destination_anchor_id"),
        F.col("p_brand").alias("source_asset_code"),
        F.col("p_type").alias("source_asset_issuer"),
    ).agg(
        F.round(exact_sum("l_extendedprice"), 4).alias("volume_usd"),
        F.round(100.0 * F.count_if(F.col("l_returnflag") != "R") / F.count("*"), 6).alias("success_rate"),
        F.max("p_size").cast("double").alias("liquidity_score"),
    )


@query(
    "graph_nodes",
    f"""{_GRAPH} SELECT anchor_id AS id, name, 'anchor' AS type, coalesce(nullif(reliability_score, 0), 50.0) AS val, status, NULL::VARCHAR AS issuer FROM anchors
    UNION ALL SELECT DISTINCT code || '_' || issuer, code, 'asset', 30.0, NULL, issuer FROM g WHERE da IS NOT NULL""",
)
def graph_nodes(spark, sf):
    anchors = anchor_frame(spark, sf).select(F.col("anchor_id").alias("id"), "name", "reliability_score", "status")
    return anc.graph_nodes(anchors, graph_corridors(spark, sf))


@query(
    "graph_links",
    f"""{_GRAPH} SELECT sa AS source, code || '_' || issuer AS target, 'issuance' AS type, volume_usd AS value, NULL::DOUBLE AS health, NULL::DOUBLE AS liquidity, 'unknown' AS health_band FROM g WHERE da IS NOT NULL
    UNION ALL SELECT code || '_' || issuer, da, 'corridor', volume_usd, success_rate, liquidity_score,
      CASE WHEN success_rate >= 90 THEN 'healthy' WHEN success_rate >= 70 THEN 'warning' ELSE 'critical' END FROM g WHERE da IS NOT NULL""",
)
def graph_links(spark, sf):
    return anc.link_health(anc.graph_links(graph_corridors(spark, sf)))


# ---- wallets -------------------------------------------------------------------------------------

_WALLET = f"""WITH {PAYMENTS}, hold AS (SELECT source_account AS wallet, asset, {dsum('amount_usd')} AS amount FROM payments GROUP BY 1, 2),
  price AS (SELECT p_brand AS asset, l_shipdate AS ts, {davg('l_extendedprice / l_quantity / 1000')} AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def holdings(spark, sf):
    return (
        payments(spark, sf, "source_account", "asset", "amount_usd")
        .groupBy(F.col("source_account").alias("wallet"), "asset")
        .agg(F.round(exact_sum("amount_usd"), 4).alias("amount"))
    )


def prices(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        table(spark, sf, "lineitem")
        .join(part, F.expr("l_partkey = p_partkey"))
        .groupBy(F.col("p_brand").alias("asset"), F.col("l_shipdate").alias("ts"))
        .agg(F.round(exact_avg(F.col("l_extendedprice") / F.col("l_quantity") / 1000), 6).alias("price"))
    )


@query(
    "wallet_portfolio",
    f"""{_WALLET}, b AS (SELECT asset, arg_max(price, ts) AS p, arg_max(price, ts) FILTER (ts <= {AS_OF_SQL} - INTERVAL 24 HOUR) AS q FROM price WHERE ts <= {AS_OF_SQL} GROUP BY 1),
    v AS (SELECT wallet, CAST(sum(CAST(amount * p AS DECIMAL(38,12))) AS DOUBLE) AS v1, CAST(sum(CAST(amount * coalesce(q, p) AS DECIMAL(38,12))) AS DOUBLE) AS v0, count(*) FILTER (amount > 0) AS n, count(*) FILTER (amount > 0 AND p IS NULL) AS u FROM hold LEFT JOIN b USING (asset) GROUP BY 1),
    t AS (SELECT source_account AS wallet, count(*) FILTER (ts > {AS_OF_SQL} - INTERVAL 30 DAY) AS c, max(ts) AS l FROM payments WHERE ts <= {AS_OF_SQL} GROUP BY 1)
    SELECT wallet, round(coalesce(v1, 0), 3) AS total_value_usd, round(coalesce(v1 - v0, 0), 3) AS change_24h_usd, round((v1 - v0) / nullif(v0, 0) * 100, 4) AS change_24h_pct, n AS asset_count, u AS unpriced_count,
    coalesce(c, 0) AS transactions_30d, l AS last_activity FROM v LEFT JOIN t USING (wallet)""",
)
def wallet_portfolio(spark, sf):
    transfers = payments(spark, sf, "source_account", "ts").withColumnRenamed("source_account", "wallet")
    df = wallets.wallet_portfolio(holdings(spark, sf), transfers, prices(spark, sf), AS_OF)
    return rounded(df, total_value_usd=3, change_24h_usd=3, change_24h_pct=4)


@query(
    "wallet_allocation",
    f"""{_WALLET} SELECT wallet, asset, amount, round(100.0 * amount / nullif(sum(amount) OVER (PARTITION BY wallet), 0), 6) AS allocation_pct FROM hold""",
)
def wallet_allocation(spark, sf):
    return rounded(wallets.wallet_allocation(holdings(spark, sf), "amount"), allocation_pct=6)


_ACT = f"WITH {PAYMENTS}, act AS (SELECT source_account AS wallet, CAST(ts AS DATE) AS date, count(*) AS count FROM payments GROUP BY 1, 2)"


def activity(spark, sf):
    return wallets.wallet_activity(payments(spark, sf, "source_account", "ts").withColumnRenamed("source_account", "wallet"))


@query("wallet_activity", f"{_ACT} SELECT * FROM act")
def wallet_activity(spark, sf):
    return activity(spark, sf)


@query(
    "wallet_activity_summary",
    f"""{_ACT} SELECT wallet, CAST(sum(count) AS BIGINT) AS total, count(*) AS active_days, round(CAST(sum(count) AS DOUBLE) / count(*), 1) AS mean_per_active_day,
    arg_min(date, (-count, date)) AS busiest_day FROM act GROUP BY 1""",
)
def wallet_activity_summary(spark, sf):
    return wallets.activity_summary(activity(spark, sf))


@query(
    "densify_daily",
    f"""{_ACT}, d AS (SELECT wallet, unnest(generate_series(DATE '1999-12-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT wallet FROM act))
    SELECT wallet, date, coalesce(count, 0) AS count FROM d LEFT JOIN act USING (wallet, date)""",
)
def densify_daily(spark, sf):
    return wallets.densify_daily(activity(spark, sf), ["wallet"], date(1999, 12, 1), date(1999, 12, 31))


_USER_ACT = "act AS (SELECT user_id AS wallet, CAST(ts AS DATE) AS date, count(*) AS count FROM events GROUP BY 1, 2)"


@query(
    "calendar_grid",
    f"""WITH {_USER_ACT}, b AS (SELECT wallet, least(min(date), DATE '2024-01-31') AS f FROM act GROUP BY 1),
    w AS (SELECT wallet, f - CAST(dayofweek(f) AS INTEGER) AS f FROM b),
    d AS (SELECT wallet, f, unnest(generate_series(f, DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS date FROM w)
    SELECT wallet, date, coalesce(count, 0) AS count, (date - f) // 7 AS week, CAST(dayofweek(date) AS INTEGER) AS weekday FROM d LEFT JOIN act USING (wallet, date)""",
)
def calendar_grid(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("wallet"), F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("count"))
    )
    return wallets.calendar_grid(daily, date(2024, 1, 31), "wallet")


_BAL = f"WITH {PAYMENTS}, pts AS (SELECT source_account AS wallet, asset, ts, {dsum('amount_usd')} AS balance FROM payments GROUP BY 1, 2, 3), h AS (SELECT wallet, ts, {dsum('balance')} AS total FROM pts GROUP BY 1, 2)"


def balances(spark, sf):
    points = (
        payments(spark, sf, "source_account", "asset", "ts", "amount_usd")
        .groupBy(F.col("source_account").alias("wallet"), "asset", "ts")
        .agg(F.round(exact_sum("amount_usd"), 4).alias("balance"))
    )
    return rounded(wallets.balance_history(points), total=4)


@query("wallet_balance_history", f"{_BAL} SELECT * FROM h")
def wallet_balance_history(spark, sf):
    return balances(spark, sf)


@query("wallet_balance_summary", f"{_BAL} SELECT wallet, arg_max(total, ts) AS current, {davg('total', 9)} AS average, max(total) AS highest, min(total) AS lowest FROM h GROUP BY 1")
def wallet_balance_summary(spark, sf):
    return rounded(wallets.balance_summary(balances(spark, sf)), average=9)


@query(
    "largest_transfers",
    f"""WITH {PAYMENTS} SELECT wallet, payment_id, ts, amount_usd FROM (SELECT source_account AS wallet, payment_id, ts, amount_usd,
      row_number() OVER (PARTITION BY source_account ORDER BY amount_usd DESC, ts DESC, payment_id) AS rn FROM payments) WHERE rn <= 3""",
)
def largest_transfers(spark, sf):
    rows = payments(spark, sf, "source_account", "payment_id", "ts", "amount_usd").withColumnRenamed("source_account", "wallet")
    return wallets.largest_transfers(rows, 3)


@query(
    "largest_transfers_overall",
    f"WITH {PAYMENTS} SELECT source_account AS wallet, payment_id, ts, amount_usd FROM payments ORDER BY amount_usd DESC, ts DESC, payment_id LIMIT 25",
)
def largest_transfers_overall(spark, sf):
    rows = payments(spark, sf, "source_account", "payment_id", "ts", "amount_usd").withColumnRenamed("source_account", "wallet")
    return wallets.largest_transfers(rows, 25, per_wallet=False)


# ---- pools and trustlines ------------------------------------------------------------------------

POOLS = f"""snap AS (SELECT p_brand AS pool, l_shipdate AS snapshot_at, {dsum('l_extendedprice')} AS tvl_usd, {dsum('l_extendedprice * (1 - l_discount)')} AS volume_24h_usd,
    {dsum('l_extendedprice * l_tax')} AS fees_24h_usd, {davg('l_discount * 365')} AS apy, {davg('l_tax * 100')} AS impermanent_loss_pct
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  pools AS (SELECT s.* FROM snap s JOIN (SELECT pool, max(snapshot_at) AS m FROM snap GROUP BY 1) l ON s.pool = l.pool AND s.snapshot_at = l.m)"""


def pool_snapshots(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    df = (
        table(spark, sf, "lineitem")
        .join(part, F.expr("l_partkey = p_partkey"))
        .groupBy(F.col("p_brand").alias("pool"), F.col("l_shipdate").alias("snapshot_at"))
        .agg(
            exact_sum(price).alias("tvl_usd"),
            exact_sum(price * (1 - discount)).alias("volume_24h_usd"),
            exact_sum(price * F.col("l_tax")).alias("fees_24h_usd"),
            exact_avg(discount * 365).alias("apy"),
            exact_avg(F.col("l_tax") * 100).alias("impermanent_loss_pct"),
        )
    )
    return rounded(df, tvl_usd=4, volume_24h_usd=4, fees_24h_usd=4, apy=6, impermanent_loss_pct=6)


def latest_pools(spark, sf):
    return rankings.latest_per_key(pool_snapshots(spark, sf), ["pool"], ["snapshot_at"])


@query("pool_snapshots", f"WITH {POOLS} SELECT * FROM snap")
def pool_snapshots_query(spark, sf):
    return pool_snapshots(spark, sf)


@query(
    "pool_stats",
    f"""WITH {POOLS} SELECT count(*) AS pools, {dsum('tvl_usd', 3)} AS tvl_usd, {dsum('volume_24h_usd', 3)} AS volume_24h_usd, {dsum('fees_24h_usd', 3)} AS fees_24h_usd,
    {davg('apy', 4)} AS average_apy, {davg('impermanent_loss_pct', 4)} AS average_impermanent_loss FROM pools""",
)
def pool_stats(spark, sf):
    return rounded(
        pools.pool_stats(latest_pools(spark, sf)),
        tvl_usd=3, volume_24h_usd=3, fees_24h_usd=3, average_apy=4, average_impermanent_loss=4,
    )


@query(
    "pool_rankings",
    f"""WITH {POOLS} SELECT pool, tvl_usd, apy, CASE WHEN impermanent_loss_pct < 1 THEN 'low' WHEN impermanent_loss_pct < 5 THEN 'medium' ELSE 'high' END AS il_severity
    FROM pools ORDER BY apy DESC, pool LIMIT 10""",
)
def pool_rankings(spark, sf):
    ranked = rankings.sortable_top(pools.pool_severity(latest_pools(spark, sf)), "apy", "pool")
    return ranked.select("pool", "tvl_usd", "apy", "il_severity")


@query("tvl_history", f"WITH {POOLS} SELECT CAST(snapshot_at AS DATE) AS date, {dsum('tvl_usd')} AS tvl_usd FROM snap GROUP BY 1")
def tvl_history(spark, sf):
    return rounded(network.tvl_history(pool_snapshots(spark, sf)), tvl_usd=4)


TRUST = """snap AS (SELECT p_brand AS asset_code, p_type AS asset_issuer, date_trunc('month', l_shipdate)::DATE AS snapshot_at, count(*) AS total_trustlines,
    count(*) FILTER (l_returnflag <> 'R') AS authorized_trustlines, count(*) FILTER (l_returnflag = 'R') AS unauthorized_trustlines
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
  trust AS (SELECT p_brand AS asset_code, p_type AS asset_issuer, count(l_partkey) AS total_trustlines, count(*) FILTER (l_returnflag <> 'R') AS authorized_trustlines,
    count(*) FILTER (l_returnflag = 'R') AS unauthorized_trustlines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _trust_aggs():
    flag = F.col("l_returnflag")
    return [
        F.count("l_partkey").alias("total_trustlines"),
        F.count_if(flag != "R").alias("authorized_trustlines"),
        F.count_if(flag == "R").alias("unauthorized_trustlines"),
    ]


def _part_lines(spark, sf, how="inner"):
    part = table(spark, sf, "part").selectExpr("p_partkey", "p_brand AS asset_code", "p_type AS asset_issuer")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_shipdate")
    return part.join(lines, F.expr("l_partkey = p_partkey"), how)


def trustlines(spark, sf):
    return _part_lines(spark, sf, "left").groupBy("asset_code", "asset_issuer").agg(*_trust_aggs())


@query("trustline_stats", f"WITH {TRUST} SELECT count(*) AS assets_tracked, CAST(sum(total_trustlines) AS BIGINT) AS total_trustlines, count(*) FILTER (total_trustlines > 0) AS active_assets FROM trust")
def trustline_stats(spark, sf):
    return pools.trustline_stats(trustlines(spark, sf))


@query(
    "trustline_shares",
    f"WITH {TRUST} SELECT *, round(100.0 * authorized_trustlines / nullif(total_trustlines, 0), 6) AS authorized_pct, round(100.0 * unauthorized_trustlines / nullif(total_trustlines, 0), 6) AS unauthorized_pct FROM trust",
)
def trustline_shares(spark, sf):
    return rounded(pools.trustline_shares(trustlines(spark, sf)), authorized_pct=6, unauthorized_pct=6)


@query("trustline_rankings", f"WITH {TRUST} SELECT * FROM trust ORDER BY total_trustlines DESC, asset_code, asset_issuer LIMIT 50")
def trustline_rankings(spark, sf):
    return pools.trustline_rankings(trustlines(spark, sf))


def trustline_snapshots(spark, sf):
    return _part_lines(spark, sf).groupBy(
        "asset_code", "asset_issuer", F.trunc(F.to_date("l_shipdate"), "month").alias("snapshot_at")
    ).agg(*_trust_aggs())


@query(
    "trustline_history",
    f"WITH {TRUST} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_code, asset_issuer ORDER BY snapshot_at DESC) AS rn FROM snap) WHERE rn <= 30",
)
def trustline_history(spark, sf):
    return rankings.last_n(trustline_snapshots(spark, sf), ["asset_code", "asset_issuer"], ["snapshot_at"], 30)


@query(
    "trustline_growth",
    f"""WITH {TRUST}, e AS (SELECT asset_code, asset_issuer, arg_min(total_trustlines, snapshot_at) AS earliest, arg_max(total_trustlines, snapshot_at) AS latest FROM snap GROUP BY 1, 2)
    SELECT *, latest - earliest AS growth, CASE WHEN earliest > 0 THEN round(100.0 * (latest - earliest) / earliest, 6) ELSE 0.0 END AS growth_pct FROM e""",
)
def trustline_growth(spark, sf):
    return rounded(
        rankings.growth(trustline_snapshots(spark, sf), ["asset_code", "asset_issuer"], "snapshot_at", "total_trustlines"),
        growth_pct=6,
    )


_INSIGHTS = f"""WITH {PAYMENTS}, h AS (SELECT asset AS asset_code, source_account AS holder, sum(CAST(amount_usd AS DECIMAL(38,12))) AS held,
      sum(CAST(amount_usd AS DECIMAL(38,12))) FILTER (ts > {AS_OF_SQL} - INTERVAL 30 DAY) AS recent, min(ts) AS joined FROM payments WHERE ts <= {AS_OF_SQL} GROUP BY 1, 2),
    i AS (SELECT asset_code, round(CAST(max(held) AS DOUBLE) / CAST(sum(held) AS DOUBLE) * 100, 6) AS largest_holder_pct, count(*) FILTER (joined > {AS_OF_SQL} - INTERVAL 30 DAY) AS holder_growth_30d,
      round(coalesce(CAST(sum(recent) AS DOUBLE), 0.0), 4) AS transfer_volume_30d,
      round(CAST(sum(held) AS DOUBLE) / greatest(1.0, date_diff('day', min(joined), {AS_OF_SQL}) / 30.0), 3) AS avg_transfer_volume, count(*) AS total_trustlines FROM h GROUP BY 1)"""


def insights(spark, sf):
    transfers = payments(spark, sf, "asset", "source_account", "ts", "amount_usd").withColumnsRenamed(
        {"asset": "asset_code", "source_account": "holder"}
    )
    return rounded(
        pools.asset_insights(transfers, AS_OF), largest_holder_pct=6, transfer_volume_30d=4, avg_transfer_volume=3
    )


@query("asset_insights", f"{_INSIGHTS} SELECT * FROM i")
def asset_insights(spark, sf):
    return insights(spark, sf)


@query(
    "asset_insight_sentences",
    f"""{_INSIGHTS}, s AS (SELECT *, transfer_volume_30d / avg_transfer_volume AS r,
      CASE WHEN transfer_volume_30d >= 1e6 THEN regexp_replace(printf('%.1f', round(transfer_volume_30d / 1e6, 1)), '\\.0$', '') || 'M'
           WHEN transfer_volume_30d >= 1e3 THEN regexp_replace(printf('%.1f', round(transfer_volume_30d / 1e3, 1)), '\\.0$', '') || 'K'
           ELSE regexp_replace(printf('%.1f', round(transfer_volume_30d, 1)), '\\.0$', '') END AS v FROM i)
    SELECT asset_code, 'The largest single holder controls ' || printf('%.1f', round(largest_holder_pct, 1)) || '% of supply' ||
        CASE WHEN largest_holder_pct > 50 THEN ', indicating high concentration' WHEN largest_holder_pct > 20 THEN ', showing moderate concentration' ELSE ', suggesting broad distribution' END || '.' || ' | ' ||
      CASE WHEN total_trustlines < 50 THEN 'Trustline count changed by ' || CASE WHEN holder_growth_30d > 0 THEN '+' ELSE '' END || holder_growth_30d || ' over 30 days — sample size is small, so trends may not be representative.'
           WHEN holder_growth_30d > 0 THEN 'Holder count grew by ' || holder_growth_30d || ' over the past 30 days.'
           ELSE 'Holder count was flat over the past 30 days.' END || ' | ' ||
      '30-day transfer volume (' || v || ') is ' || CASE WHEN r > 1.2 THEN printf('%.0f', round((r - 1) * 100, 0)) || '% above the historical average.'
           WHEN r < 0.8 THEN printf('%.0f', round((1 - r) * 100, 0)) || '% below the historical average.' ELSE 'in line with the historical average.' END AS sentences FROM s""",
)
def asset_insight_sentences(spark, sf):
    return pools.insight_sentences(insights(spark, sf)).select("asset_code", F.array_join("sentences", " | ").alias("sentences"))


# ---- governance, jobs, quests --------------------------------------------------------------------

_VOTES = """WITH c AS (SELECT l_partkey AS proposal_id, count(*) FILTER (l_returnflag = 'A') AS votes_for, count(*) FILTER (l_returnflag = 'N') AS votes_against,
    count(*) FILTER (l_returnflag = 'R') AS votes_abstain, count(DISTINCT l_suppkey) AS voters FROM lineitem GROUP BY 1)"""


def votes_frame(spark, sf):
    choice = (
        F.when(F.col("l_returnflag") == "A", "for").when(F.col("l_returnflag") == "N", "against").otherwise("abstain")
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("proposal_id"), F.col("l_suppkey").alias("voter"), choice.alias("choice")
    )


def vote_counts_frame(spark, sf):
    return gov.vote_counts(votes_frame(spark, sf))


@query("top_voters", "SELECT l_suppkey AS voter, count(DISTINCT l_partkey) AS proposals FROM lineitem GROUP BY 1 ORDER BY proposals DESC, voter LIMIT 10")
def top_voters(spark, sf):
    return gov.top_voters(votes_frame(spark, sf))


@query("vote_counts", f"{_VOTES} SELECT * FROM c")
def vote_counts(spark, sf):
    return vote_counts_frame(spark, sf)


@query(
    "vote_breakdown",
    f"""{_VOTES}, t AS (SELECT *, votes_for + votes_against + votes_abstain AS total_votes FROM c)
    SELECT *, round(100.0 * votes_for / nullif(total_votes, 0), 6) AS for_pct, round(100.0 * votes_against / nullif(total_votes, 0), 6) AS against_pct, round(100.0 * votes_abstain / nullif(total_votes, 0), 6) AS abstain_pct FROM t""",
)
def vote_breakdown(spark, sf):
    return rounded(gov.vote_breakdown(vote_counts_frame(spark, sf)), for_pct=6, against_pct=6, abstain_pct=6)


@query(
    "turnout",
    f"{_VOTES} SELECT proposal_id, voters, votes_for + votes_against + votes_abstain AS votes, round(100.0 * voters / 1000, 6) AS turnout_pct FROM c",
)
def turnout(spark, sf):
    return rounded(gov.turnout(vote_counts_frame(spark, sf), eligible=1000), turnout_pct=6)


@query(
    "governance_summary",
    f"""{_VOTES}, p AS (SELECT p_partkey, CASE WHEN p_size >= 34 THEN 'active' WHEN p_size >= 17 THEN 'passed' ELSE 'failed' END AS status,
      coalesce(votes_for + votes_against + votes_abstain, 0) AS v FROM part LEFT JOIN c ON proposal_id = p_partkey)
    SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(v) AS BIGINT) AS total_votes FROM p""",
)
def governance_summary(spark, sf):
    size = F.col("p_size")
    proposals = table(spark, sf, "part").select(
        F.col("p_partkey").alias("proposal_id"),
        F.when(size >= 34, "active").when(size >= 17, "passed").otherwise("failed").alias("status"),
    )
    votes = gov.vote_breakdown(vote_counts_frame(spark, sf)).select("proposal_id", "total_votes")
    return gov.governance_summary(proposals.join(votes, "proposal_id", "left"))


JOBS = """jobs AS (SELECT 'job-' || user_id AS name, count(*) AS executions, count(*) FILTER (event_type = 'error') AS failures,
    max(ts) > TIMESTAMP '2024-01-29' AS active, CASE WHEN count(*) FILTER (event_type = 'error') * 4 > count(*) THEN 'critical'
    WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 'warning' ELSE 'healthy' END AS health_status FROM events GROUP BY user_id)"""


def jobs_frame(spark, sf):
    runs = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("executions"),
        F.count_if(F.col("event_type") == "error").alias("failures"),
        (F.max("ts") > F.lit(datetime(2024, 1, 29))).alias("active"),
    )
    health = (
        F.when(F.col("failures") * 4 > F.col("executions"), "critical")
        .when(F.col("failures") * 5 > F.col("executions"), "warning")
        .otherwise("healthy")
    )
    return runs.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("name"), "executions", "failures", "active",
        health.alias("health_status"),
    )


@query(
    "job_summary",
    f"""WITH {JOBS} SELECT count(*) AS total_jobs, count(*) FILTER (active) AS active_jobs, count(*) FILTER (health_status = 'healthy') AS healthy,
    count(*) FILTER (health_status = 'warning') AS warning, count(*) FILTER (health_status = 'critical') AS critical, CAST(sum(executions) AS BIGINT) AS executions,
    CAST(sum(failures) AS BIGINT) AS failures, round(100.0 * (sum(executions) - sum(failures)) / sum(executions), 6)::DOUBLE AS success_rate FROM jobs""",
)
def job_summary(spark, sf):
    return rounded(gov.job_summary(jobs_frame(spark, sf)), success_rate=6)


@query("job_list", f"WITH {JOBS} SELECT * FROM jobs ORDER BY CASE health_status WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'healthy' THEN 2 ELSE 3 END, name")
def job_list(spark, sf):
    return gov.job_list(jobs_frame(spark, sf))


_QUEST_IDS = [q[0] for q in gov.QUESTS] + ["no-such-quest", "other"]
_QUESTS = f"""WITH {EVENTS}, q(quest_id, category, xp) AS (VALUES {', '.join(f"('{q[0]}', '{q[1]}', {q[2]})" for q in gov.QUESTS)}),
  progress AS (SELECT DISTINCT user_id, {_QUEST_IDS}[k // 9 + 1] AS quest_id FROM ev WHERE event_type = 'purchase'),
  s AS (SELECT user_id, CAST(coalesce(sum(xp), 0) AS BIGINT) AS xp, count(*) AS completed, count(*) FILTER (category = 'defi') AS defi FROM progress LEFT JOIN q USING (quest_id) GROUP BY 1)"""


def quest_scores_frame(spark, sf):
    ids = F.array(*[F.lit(q) for q in _QUEST_IDS])
    progress = (
        events(spark, sf)
        .where(F.col("event_type") == "purchase")
        .select("user_id", F.get(ids, F.floor(F.col("k") / 9).cast("int")).alias("quest_id"))
        .distinct()
    )
    return gov.quest_scores(progress, gov.quest_table(spark))


@query("xp_leaderboard", f"{_QUESTS} SELECT user_id, xp, completed, row_number() OVER (ORDER BY xp DESC, user_id) AS rank FROM s")
def xp_leaderboard(spark, sf):
    return gov.leaderboard(quest_scores_frame(spark, sf))


@query(
    "achievements",
    f"""{_QUESTS}, a(achievement, kind, threshold) AS (VALUES {', '.join(f"('{a}', '{k}', {t})" for a, k, t in gov.ACHIEVEMENTS)})
    SELECT user_id, achievement FROM s JOIN a ON CASE WHEN kind = 'quests' THEN completed ELSE defi END >= threshold""",
)
def achievements(spark, sf):
    return gov.achievements(quest_scores_frame(spark, sf))
