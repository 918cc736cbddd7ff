"""Common table expressions shared by the SQL equivalents."""

PAYMENTS = """payments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS payment_id,
         l_shipdate AS ts, l_orderkey AS ledger_sequence,
         CASE WHEN l_linestatus = 'O' THEN 'mainnet' ELSE 'testnet' END AS network,
         o_custkey AS source_account, l_suppkey AS dest_account,
         src.n_name AS source_asset, dst.n_name AS dest_asset,
         src.n_name || '->' || dst.n_name AS corridor,
         s_name AS anchor, p_brand AS asset,
         l_extendedprice * (1 - l_discount) AS amount_usd,
         l_extendedprice * l_tax AS fee,
         l_returnflag <> 'R' AS successful,
         CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS reliability,
         CAST(abs(date_diff('day', o_orderdate, l_shipdate)) * 1000 AS DOUBLE) AS latency_ms,
         l_discount * 10000 AS slippage_bps,
         CASE WHEN l_returnflag = 'R' THEN p_type END AS failure_reason,
         l_linenumber AS operation_index
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
  JOIN nation src ON c_nationkey = src.n_nationkey
  JOIN nation dst ON s_nationkey = dst.n_nationkey
)"""

EVENTS = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
)"""


def dsum(expr: str, digits: int = 4) -> str:
    """Exact decimal sum as a rounded double."""
    return f"round(CAST(sum(CAST({expr} AS DECIMAL(38,12))) AS DOUBLE), {digits})"


def davg(expr: str, digits: int = 6) -> str:
    """Mean from the exact decimal sum, rounded."""
    return f"round(CAST(sum(CAST({expr} AS DECIMAL(38,12))) AS DOUBLE) / nullif(count({expr}), 0), {digits})"
