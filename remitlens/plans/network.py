"""Network series, contract activity, rankings and paging over the supplied tables."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from remitlens.operators import network as op
from remitlens.operators import paging, rankings
from remitlens.plans.common import EVENTS_AS_OF, EVENTS_AS_OF_SQL
from remitlens.plans.registry import query, rounded
from remitlens.plans.views import EVENTS, PAYMENTS, davg, dsum
from remitlens.sources.tables import events, payments, table

_P = f"WITH {PAYMENTS}"


@query("daily_payment_volume", f"{_P} SELECT CAST(ts AS DATE) AS date, {dsum('amount_usd')} AS volume FROM payments GROUP BY 1")
def daily_payment_volume(spark, sf):
    return rounded(op.daily_payment_volume(payments(spark, sf, "ts", "amount_usd")), volume=4)


_SIDES = f"{_P}, sides AS (SELECT ts, source_account AS account FROM payments UNION ALL SELECT ts, dest_account FROM payments)"


@query("daily_active_accounts", f"{_SIDES} SELECT CAST(ts AS DATE) AS date, count(DISTINCT account) AS active_accounts FROM sides GROUP BY 1")
def daily_active_accounts(spark, sf):
    return op.daily_active_accounts(payments(spark, sf, "ts", "source_account", "dest_account"))


@query("transactions_per_day", f"{_P} SELECT CAST(ts AS DATE) AS date, count(*) AS transactions FROM payments GROUP BY 1")
def transactions_per_day(spark, sf):
    return op.transactions_per_day(payments(spark, sf, "ts"))


@query(
    "new_accounts_per_day",
    f"{_SIDES}, f AS (SELECT account, min(ts) AS t FROM sides GROUP BY 1) SELECT CAST(t AS DATE) AS date, count(*) AS new_accounts FROM f GROUP BY 1",
)
def new_accounts_per_day(spark, sf):
    return op.new_accounts_per_day(payments(spark, sf, "ts", "source_account", "dest_account"))


@query("fee_trends", f"{_P} SELECT CAST(ts AS DATE) AS date, {davg('fee', 10)} AS average_fee FROM payments GROUP BY 1")
def fee_trends(spark, sf):
    return rounded(op.fee_trends(payments(spark, sf, "ts", "fee")), average_fee=10)


@query(
    "daily_liquidity",
    f"{_P} SELECT CAST(ts AS DATE) AS date, CAST(floor(CAST(sum(CAST(amount_usd AS DECIMAL(38,12))) AS DOUBLE) + 0.5) AS BIGINT) AS liquidity_usd FROM payments GROUP BY 1 ORDER BY 1",
)
def daily_liquidity(spark, sf):
    return op.daily_liquidity(payments(spark, sf, "ts", "amount_usd"), "amount_usd")


@query(
    "series_summary",
    f"""{_P}, s AS (SELECT CAST(ts AS DATE) AS date, {dsum('amount_usd')} AS v FROM payments GROUP BY 1)
    SELECT {dsum('v')} AS total, max(v) AS peak, arg_max(v, date) AS latest, {davg('v')} AS average, min(v) AS minimum FROM s""",
)
def series_summary(spark, sf):
    return rounded(op.series_summary(daily_payment_volume(spark, sf), "volume"), total=4, average=6)


# Contract activity: the user is the contract, the property the transaction, the value the gas.
_CONTRACT = f"""WITH {EVENTS}, c AS (SELECT event_id, ts, 'C' || user_id AS contract_id, user_id * 100 + k AS tx_id, value AS gas,
  CASE event_type WHEN 'signup' THEN 'deploy' WHEN 'purchase' THEN 'init' ELSE 'call' END AS kind FROM ev)"""


def contract_activity(spark, sf):
    kind = F.when(F.col("event_type") == "signup", F.lit("deploy")).when(F.col("event_type") == "purchase", F.lit("init"))
    return events(spark, sf).select(
        "event_id",
        "ts",
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("contract_id"),
        (F.col("user_id") * 100 + F.col("k")).alias("tx_id"),
        F.col("value").alias("gas"),
        kind.otherwise(F.lit("call")).alias("kind"),
    )


@query("contract_calls_daily", f"{_CONTRACT} SELECT CAST(ts AS DATE) AS date, count(*) AS calls FROM c GROUP BY 1")
def contract_calls_daily(spark, sf):
    return op.contract_calls_daily(contract_activity(spark, sf))


@query(
    "top_contracts",
    f"""{_CONTRACT} SELECT contract_id, count(DISTINCT tx_id) AS calls, count(*) AS events, max(ts) AS last_seen FROM c
    WHERE ts > {EVENTS_AS_OF_SQL} - INTERVAL 7 DAY AND ts <= {EVENTS_AS_OF_SQL}
    GROUP BY 1 ORDER BY calls DESC, events DESC, contract_id LIMIT 10""",
)
def top_contracts(spark, sf):
    return op.top_contracts(contract_activity(spark, sf), EVENTS_AS_OF - timedelta(days=7), EVENTS_AS_OF)


_WINDOWS = f"""w AS (SELECT *, ts > {EVENTS_AS_OF_SQL} - INTERVAL 7 DAY AND ts <= {EVENTS_AS_OF_SQL} AS now,
  ts > {EVENTS_AS_OF_SQL} - INTERVAL 14 DAY AND ts <= {EVENTS_AS_OF_SQL} - INTERVAL 7 DAY AS before FROM c)"""


def _direction(expr: str) -> str:
    return f"CASE WHEN {expr} > 0 THEN 'up' WHEN {expr} < 0 THEN 'down' END"


@query(
    "active_contracts",
    f"""{_CONTRACT}, {_WINDOWS}, n AS (SELECT count(DISTINCT contract_id) FILTER (now) AS a, count(DISTINCT contract_id) FILTER (before) AS b FROM w)
    SELECT a AS active_contracts, b AS previous_contracts, round((a - b) * 100.0 / nullif(b, 0), 6)::DOUBLE AS trend_pct, {_direction('a - b')} AS direction FROM n""",
)
def active_contracts(spark, sf):
    return rounded(op.active_contracts(contract_activity(spark, sf), EVENTS_AS_OF, timedelta(days=7)), trend_pct=6)


@query(
    "gas_usage",
    f"""{_CONTRACT}, {_WINDOWS}, n AS (SELECT {dsum('CASE WHEN now THEN gas END')} AS a, {davg('CASE WHEN now THEN gas END')} AS m, {dsum('CASE WHEN before THEN gas END')} AS b FROM w)
    SELECT a AS total_gas, m AS average_gas, b AS previous_gas, round((a - b) * 100.0 / nullif(b, 0), 6) AS trend_pct, {_direction('a - b')} AS direction FROM n""",
)
def gas_usage(spark, sf):
    return rounded(
        op.gas_usage(contract_activity(spark, sf), EVENTS_AS_OF, timedelta(days=7)),
        total_gas=4, average_gas=6, previous_gas=4, trend_pct=6,
    )


@query(
    "new_deployments",
    f"""{_CONTRACT}, d AS (SELECT contract_id, min(ts) FILTER (kind = 'deploy') AS deployed_at, NOT bool_or(kind = 'init') AS partial FROM c GROUP BY 1)
    SELECT * FROM d WHERE deployed_at IS NOT NULL ORDER BY deployed_at DESC, contract_id LIMIT 10""",
)
def new_deployments(spark, sf):
    return op.new_deployments(contract_activity(spark, sf))


@query(
    "latest_ledger",
    f"""{_P}, l AS (SELECT ledger_sequence, max(ts) AS closed_at, count(DISTINCT operation_index) AS transaction_count, count(*) AS operation_count FROM payments GROUP BY 1)
    SELECT * FROM l WHERE ledger_sequence = (SELECT max(ledger_sequence) FROM payments)""",
)
def latest_ledger(spark, sf):
    return op.latest_ledger(
        payments(spark, sf, "ledger_sequence", "ts", "operation_index").withColumnRenamed("operation_index", "tx_id")
    )


@query(
    "period_trend",
    f"""{_P}, s AS (SELECT network, date_trunc('month', ts)::DATE AS month, count(*) AS n FROM payments GROUP BY 1, 2),
    p AS (SELECT *, lag(n) OVER (PARTITION BY network ORDER BY month) AS q FROM s)
    SELECT network, month, n, round((n - q) * 100.0 / nullif(q, 0), 6)::DOUBLE AS trend_pct, {_direction('n - q')} AS direction FROM p""",
)
def period_trend(spark, sf):
    monthly = (
        payments(spark, sf, "network", "ts")
        .groupBy("network", F.trunc(F.to_date("ts"), "month").alias("month"))
        .agg(F.count("*").alias("n"))
    )
    return rounded(op.period_trend(monthly, ["network"], "month", "n"), trend_pct=6)


# Asset movers: unit price per asset, the latest against the newest of at least 24 h before. An asset's
# holders are the accounts that ever bought it.
MOVERS_AS_OF = datetime(2001, 11, 4)
_MOVERS = f"""WITH l AS (SELECT p_brand AS asset_code, p_type AS asset_issuer, l_shipdate AS ts, l_extendedprice, l_quantity, o_custkey
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= TIMESTAMP '{MOVERS_AS_OF}'),
  d AS (SELECT asset_code, asset_issuer, ts, {davg('l_extendedprice / l_quantity')} AS price, {dsum('l_extendedprice')} AS volume FROM l GROUP BY 1, 2, 3),
  h AS (SELECT asset_code, asset_issuer, count(DISTINCT o_custkey) AS holder_count FROM l GROUP BY 1, 2),
  n AS (SELECT asset_code, asset_issuer, arg_max(price, ts) AS price_usd, coalesce(sum(volume) FILTER (ts > TIMESTAMP '{MOVERS_AS_OF - timedelta(hours=24)}'), 0.0) AS volume_24h_usd,
          arg_max(price, ts) FILTER (ts <= TIMESTAMP '{MOVERS_AS_OF - timedelta(hours=24)}') AS p24 FROM d GROUP BY 1, 2),
  a AS (SELECT asset_code, asset_issuer, price_usd, volume_24h_usd, holder_count, round((price_usd - p24) * 100.0 / nullif(p24, 0), 6) AS change_24h_pct
        FROM n JOIN h USING (asset_code, asset_issuer))"""


def asset_trades(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    return lines.where(F.col("l_shipdate") <= F.lit(MOVERS_AS_OF)).join(orders, F.expr("l_orderkey = o_orderkey")).join(part, F.expr("l_partkey = p_partkey")).select(
        F.col("p_brand").alias("asset_code"), F.col("p_type").alias("asset_issuer"), F.col("l_shipdate").alias("ts"), "l_extendedprice", "l_quantity", "o_custkey"
    )


def movers(spark, sf):
    from remitlens.functions.numbers import exact_avg, exact_sum
    from remitlens.operators.wallets import baseline_24h

    key = ["asset_code", "asset_issuer"]
    trades = asset_trades(spark, sf)
    daily = trades.groupBy(*key, "ts").agg(
        F.round(exact_avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("price"),
        F.round(exact_sum("l_extendedprice"), 4).alias("volume"),
    )
    # what was traded in the 24 hours before, not on the last day that had a trade
    recent = F.col("ts") > F.lit(MOVERS_AS_OF - timedelta(hours=24))
    latest = daily.groupBy(*key).agg(F.coalesce(exact_sum(F.when(recent, F.col("volume"))), F.lit(0.0)).alias("volume_24h_usd"))
    # members first, then their number: a popular asset is never gathered
    holders = trades.select(*key, "o_custkey").distinct().groupBy(*key).agg(F.count("o_custkey").alias("holder_count"))
    change = baseline_24h(daily, key, MOVERS_AS_OF)
    return rounded(latest.join(change, key).join(holders, key), change_24h_pct=6).select(
        *key, "price_usd", "volume_24h_usd", "holder_count", "change_24h_pct"
    )


@query("baseline_24h", f"{_MOVERS} SELECT asset_code, asset_issuer, price_usd, change_24h_pct FROM a")
def baseline_24h(spark, sf):
    return movers(spark, sf).select("asset_code", "asset_issuer", "price_usd", "change_24h_pct")


def _rank(order: str, limit: int, where: str = "true") -> str:
    return f"""{_MOVERS} SELECT *, row_number() OVER (ORDER BY {order}, asset_code, asset_issuer) AS rank FROM a WHERE {where}
    ORDER BY rank LIMIT {limit}"""


@query("top_movers_change", _rank("abs(change_24h_pct) DESC NULLS LAST", 10))
def top_movers_change(spark, sf):
    return rankings.top_movers(movers(spark, sf), "change", 10)


@query("top_movers_volume", _rank("volume_24h_usd DESC", 10))
def top_movers_volume(spark, sf):
    return rankings.top_movers(movers(spark, sf), "volume", 10)


@query("top_movers_losers", _rank("abs(change_24h_pct) DESC NULLS LAST", 5, "change_24h_pct < 0"))
def top_movers_losers(spark, sf):
    return rankings.top_movers(movers(spark, sf), "change", 5, direction="losers")


@query("asset_rankings_holders", _rank("holder_count DESC", 20))
def asset_rankings_holders(spark, sf):
    return rankings.asset_rankings(movers(spark, sf), "holders", 20)


@query("asset_rankings_volume", _rank("volume_24h_usd DESC", 20))
def asset_rankings_volume(spark, sf):
    return rankings.asset_rankings(movers(spark, sf), "volume", 20)


@query(
    "latest_per_key",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
)
def latest_per_key(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return rankings.latest_per_key(rows, ["user_id"], ["event_id"])


@query(
    "last_n_points",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 7",
)
def last_n_points(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return rankings.last_n(rows, ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id", "value")


@query(
    "current_streak",
    f"""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20'),
    g AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM a),
    i AS (SELECT user_id, count(*) AS n, max(d) AS last FROM g GROUP BY user_id, island)
    SELECT u.user_id, coalesce(max(n) FILTER (last = DATE '2024-01-20'), 0)::BIGINT AS streak
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN i USING (user_id) GROUP BY 1""",
)
def current_streak(spark, sf):
    daily = (
        table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("count"))
    )
    return rankings.current_streak(daily, "user_id", date(2024, 1, 20))


@query("select_fields", "SELECT o_orderkey, o_orderstatus FROM orders")
def select_fields(spark, sf):
    return paging.select_fields(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


@query("sort_by_number", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def sort_by_number(spark, sf):
    return paging.sort_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ascending=False)


@query("paginate_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginate_offset(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return paging.paginate_offset(rows, ["o_totalprice desc", "o_orderkey"], 20, 40).rows


@query("paginate_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def paginate_page(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return paging.paginate_page(rows, ["o_totalprice desc", "o_orderkey"], page=3).rows


@query(
    "page_deep",
    """SELECT l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber
    LIMIT 25 OFFSET (SELECT count(*) * 7 // 10 FROM lineitem)""",
)
def page_deep(spark, sf):
    """A page at seven tenths of the lines; a thousand rows at once make the selection work at any size."""
    rows = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    total = rows.count()
    return paging.page_rows(rows, ["l_shipdate desc", "l_orderkey", "l_linenumber"], total * 7 // 10, 25, total, at_once=1000)


@query(
    "paginate_cursor",
    """SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus FROM orders
    WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1999-06-01', 100) ORDER BY created_at DESC, id DESC LIMIT 50""",
)
def paginate_cursor(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS created_at", "o_orderstatus")
    return paging.keyset_page(rows, 50, paging.encode_cursor(datetime(1999, 6, 1), 100))
