"""Readers of paged JSON envelopes and tolerant series payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.operators.contract_events import once
from remitlens.sources import schemas

AMOUNT = "decimal(20,7)"
# Field names a series payload may use, in preference order.
ENVELOPES = ["points", "series", "data"]
DATE_NAMES = ["date", "day", "timestamp"]
VALUE_NAMES = {
    "volume": ["volume", "volume_usd", "payment_volume"],
    "active_accounts": ["count", "active_accounts", "daily_active_accounts"],
    "transactions": ["count", "transactions", "tx_count"],
    "new_accounts": ["count", "new_accounts", "created_accounts"],
    "fees": ["avg_fee_stroops", "avg_fee", "average_fee"],
    "contract_calls": ["count", "call_count"],
}
NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def read_pages(spark: SparkSession, path: str, schema, lines: bool = False) -> DataFrame:
    """JSON documents of a paged endpoint: one per file, or one per line with ``lines``.

    Files of lines are split and read in parallel; a file of one document is one task.
    """
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def parse_pages(df: DataFrame, schema, value: str = "value") -> DataFrame:
    """The same from a text column."""
    return once(df, _page=F.from_json(F.col(value), schema)).select("_page.*")


def _records(pages: DataFrame) -> DataFrame:
    return pages.select(F.inline("_embedded.records"))


def payments(pages: DataFrame) -> DataFrame:
    """One row per payment record with a seven-decimal amount."""
    return _records(pages).select(
        "id",
        "transaction_successful",
        F.col("from").alias("source_account"),
        F.col("to").alias("dest_account"),
        F.coalesce("asset_code", F.when(F.col("asset_type") == "native", F.lit("XLM"))).alias("asset_code"),
        "asset_issuer",
        F.col("amount").try_cast(AMOUNT).alias("amount"),
        F.try_to_timestamp("created_at").alias("created_at"),
        "transaction_hash",
    )


def trades(pages: DataFrame) -> DataFrame:
    """One row per trade; the price is the rational n / d."""
    n, d = F.col("price.n").try_cast("double"), F.col("price.d").try_cast("double")
    return _records(pages).select(
        "id",
        "base_account",
        "counter_account",
        F.coalesce("base_asset_code", F.lit("XLM")).alias("base_asset"),
        F.coalesce("counter_asset_code", F.lit("XLM")).alias("counter_asset"),
        F.col("base_amount").try_cast(AMOUNT).alias("base_amount"),
        F.col("counter_amount").try_cast(AMOUNT).alias("counter_amount"),
        F.try_divide(n, F.nullif(d, F.lit(0.0))).alias("price"),
        "base_is_seller",
        F.try_to_timestamp("ledger_close_time").alias("closed_at"),
    )


def orderbook(books: DataFrame) -> DataFrame:
    """One row per price level; level 0 is the best of its side."""

    def side(name: str) -> DataFrame:
        levels = books.select(
            F.coalesce("base.asset_code", F.lit("XLM")).alias("base_asset"),
            F.coalesce("counter.asset_code", F.lit("XLM")).alias("counter_asset"),
            F.posexplode(name).alias("level", "e"),
        )
        return levels.select(
            "base_asset",
            "counter_asset",
            F.lit({"bids": "bid", "asks": "ask"}[name]).alias("side"),
            "level",
            F.col("e.price").try_cast(AMOUNT).alias("price"),
            F.col("e.amount").try_cast(AMOUNT).alias("amount"),
        )

    return side("bids").unionByName(side("asks"))


def _field(value: Column, name: str) -> Column:
    """Variant field; a missing field and a JSON null both give SQL null."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(found), found)


def normalize_series(df: DataFrame, value_names: list[str], keys: list[str], value: str = "value", out: str = "number") -> DataFrame:
    """Points (date, number) of a tolerant series payload, in date order.

    The payload is a bare array or an object holding the array under points,
    series or data. The first date and the first value name that is present
    counts; a row without a date or with a non-numeric value is dropped.
    """
    parsed = once(df, _v=F.try_parse_json(F.col(value)))
    root = [F.try_variant_get("_v", "$", "array<variant>")]
    nested = [F.try_variant_get("_v", f"$.{name}", "array<variant>") for name in ENVELOPES]
    points = parsed.select(*keys, F.explode(F.coalesce(*root, *nested)).alias("_e"))
    picked = once(
        points,
        _date=F.coalesce(*[F.try_variant_get("_e", f"$.{n}", "string") for n in DATE_NAMES]),
        _number=F.coalesce(*[_field(F.col("_e"), n) for n in value_names]),
    )
    numeric = F.schema_of_variant("_number").rlike(NUMBER_KINDS)
    number = F.try_variant_get("_number", "$", "double")
    rows = picked.where((F.coalesce("_date", F.lit("")) != "") & F.coalesce(numeric, F.lit(False)))
    return (
        rows.select(*keys, F.col("_date").alias("date"), number.alias(out))
        .where(~F.isnan(out))
        .orderBy(*keys, F.coalesce(F.try_to_timestamp("date"), F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))), "date")
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG).json(path)


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_contract_events(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CONTRACT_EVENT).format(format).load(path)
