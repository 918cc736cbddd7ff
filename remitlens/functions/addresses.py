"""Account addresses, asset codes and corridor keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address formats.
G_ADDRESS = r"^G[A-Z0-9]{55}$"
M_ADDRESS = r"^M[A-Z0-9]{68}$"
ASSET = r"^[A-Z0-9]+(:[A-Z0-9]+)?$"
# Messages shown for a rejected address.
G_ERROR = "Invalid G-address: must be 56 characters (A-Z, 0-9)."
M_ERROR = "Invalid M-address: must be 69 characters (muxed account)."
PREFIX_ERROR = "Invalid address: must start with G (account) or M (muxed account)."
# Leading number of a typed amount.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def is_g_address(col: Column) -> Column:
    return F.coalesce(F.trim(col).rlike(G_ADDRESS), F.lit(False))


def is_muxed_address(col: Column) -> Column:
    return F.coalesce(F.trim(col).rlike(M_ADDRESS), F.lit(False))


def is_account_address(col: Column) -> Column:
    return is_g_address(col) | is_muxed_address(col)


def address_error(col: Column) -> Column:
    """Reason an address is rejected, null when it is valid."""
    text = F.trim(F.coalesce(col, F.lit("")))
    return (
        F.when(text == "", F.lit("Address is required."))
        .when(is_account_address(text), F.lit(None).cast("string"))
        .when(text.startswith("G"), F.lit(G_ERROR))
        .when(text.startswith("M"), F.lit(M_ERROR))
        .otherwise(F.lit(PREFIX_ERROR))
    )


def address_short(col: Column, start: int = 8, end: int = 8) -> Column:
    """First and last characters with an ellipsis, or the whole text when it is short."""
    text = F.trim(F.coalesce(col, F.lit("")))
    return F.when(F.length(text) <= start + end, text).otherwise(
        F.concat(F.substring(text, 1, start), F.lit("..."), F.right(text, F.lit(end)))
    )


def asset_code(col: Column) -> Column:
    """CODE of CODE:ISSUER."""
    return F.split(col, ":").getItem(0)


def corridor_name(source: Column, dest: Column) -> Column:
    return F.concat(asset_code(source), F.lit("-"), asset_code(dest))


def corridor_key(source: Column, source_issuer: Column, dest: Column, dest_issuer: Column) -> Column:
    return F.concat(source, F.lit(":"), source_issuer, F.lit("->"), dest, F.lit(":"), dest_issuer)


def amount_error(col: Column) -> Column:
    """Reason a typed amount is rejected, null when it is valid.

    The number is the longest numeric prefix, so "12 USD" counts as 12.
    """
    text = F.coalesce(col, F.lit(""))
    number = F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")
    parts = F.split(text, r"\.")
    return (
        F.when(number.isNull() | (number <= 0), F.lit("NotPositive"))
        .when(number > 1e12, F.lit("TooLarge"))
        .when((F.size(parts) > 2) | (F.length(F.get(parts, F.lit(1))) > 7), F.lit("TooManyDecimals"))
    )


def asset_code_error(col: Column) -> Column:
    """Empty is allowed; otherwise CODE or CODE:ISSUER with at most 64 characters."""
    text = F.trim(F.coalesce(col, F.lit("")))
    ok = (text == "") | (text.rlike(ASSET) & (F.length(text) <= 64))
    return F.when(~ok, F.lit("InvalidAsset"))


def receiver_id_error(col: Column) -> Column:
    text = F.trim(F.coalesce(col, F.lit("")))
    return F.when(text == "", F.lit("Required")).when(~F.length(text).between(3, 256), F.lit("InvalidLength"))


def asset_type_matches(col: Column, asset_type: str) -> Column:
    """alphanum4 keeps codes up to 4 characters, alphanum12 those of 5 to 12, anything else all."""
    if asset_type == "alphanum4":
        return F.length(col) <= 4
    if asset_type == "alphanum12":
        return F.length(col).between(5, 12)
    return F.lit(True)


def hex32(col: Column) -> Column:
    """Lower-case hex of exactly 32 bytes, null for any other length."""
    return F.when(F.octet_length(col) == 32, F.lower(F.hex(col)))


def signed_payload(epoch: Column, snapshot_hash: Column, source_data_hash: Column) -> Column:
    """Eight big-endian epoch bytes followed by the two 32-byte hashes."""
    return F.concat(F.unhex(F.lpad(F.hex(epoch.cast("bigint")), 16, "0")), snapshot_hash, source_data_hash)
