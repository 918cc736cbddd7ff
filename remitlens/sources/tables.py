"""Adapters from the supplied tables onto the canonical inputs.

``payments`` joins only the tables that the requested columns need, so a query
over fees reads three columns of one table and joins nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_KEY = "cast(get_json_object(props, '$.k') as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# column -> (expression, tables joined to lineitem)
_PAYMENT = {
    "payment_id": ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", []),
    "ts": ("l_shipdate", []),
    "ledger_sequence": ("l_orderkey", []),
    "network": ("if(l_linestatus = 'O', 'mainnet', 'testnet')", []),
    "source_account": ("o_custkey", ["orders"]),
    "dest_account": ("l_suppkey", []),
    "source_asset": ("src_name", ["orders", "customer", "src"]),
    "dest_asset": ("dst_name", ["supplier", "dst"]),
    "corridor": ("concat(src_name, '->', dst_name)", ["orders", "customer", "src", "supplier", "dst"]),
    "anchor": ("s_name", ["supplier"]),
    "asset": ("p_brand", ["part"]),
    "amount_usd": ("l_extendedprice * (1 - l_discount)", []),
    "fee": ("l_extendedprice * l_tax", []),
    "successful": ("l_returnflag <> 'R'", []),
    "reliability": ("if(l_returnflag <> 'R', 1.0D, 0.0D)", []),
    "latency_ms": ("cast(abs(datediff(l_shipdate, o_orderdate)) * 1000 as double)", ["orders"]),
    "slippage_bps": ("l_discount * 10000", []),
    "failure_reason": ("if(l_returnflag = 'R', p_type, null)", ["part"]),
    "operation_index": ("l_linenumber", []),
}


def payments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Canonical payments, restricted to ``columns`` (all when none are named)."""
    wanted = columns or tuple(_PAYMENT)
    needed = {name for column in wanted for name in _PAYMENT[column][1]}
    df = table(spark, sf_dir, "lineitem")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Customer attributes are resolved on the orders, so the far larger line
    # table is shuffled once, by order, and never by customer.
    if "orders" in needed:
        orders = table(spark, sf_dir, "orders")
        if "customer" in needed:
            orders = orders.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        if "src" in needed:
            orders = orders.join(nation.withColumnsRenamed({"n_nationkey": "src_key", "n_name": "src_name"}), F.expr("c_nationkey = src_key"))
        df = df.join(orders, F.expr("l_orderkey = o_orderkey"))
    if "supplier" in needed:
        supplier = table(spark, sf_dir, "supplier")
        if "dst" in needed:
            supplier = supplier.join(nation.withColumnsRenamed({"n_nationkey": "dst_key", "n_name": "dst_name"}), F.expr("s_nationkey = dst_key"))
        df = df.join(supplier, F.expr("l_suppkey = s_suppkey"))
    if "part" in needed:
        df = df.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return df.select(*[F.expr(_PAYMENT[c][0]).alias(c) for c in wanted])


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw snapshot rows: one per payment, ``source`` is the network."""
    return payments(
        spark, sf_dir, "ledger_sequence", "corridor", "network", "reliability", "amount_usd", "latency_ms"
    ).select(
        "ledger_sequence",
        "corridor",
        F.col("network").alias("source"),
        "reliability",
        F.col("amount_usd").alias("volume"),
        "latency_ms",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application events with the numeric property unpacked as ``k`` (0..99)."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.expr(EVENT_KEY).alias("k")
    )
