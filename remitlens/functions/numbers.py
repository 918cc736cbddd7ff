"""Division, rounding and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,12)"


def safe_div(numerator, denominator) -> Column:
    """Null instead of an error when the denominator is zero or null."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def pct(numerator, denominator) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.coalesce(safe_div(numerator, denominator) * 100.0, F.lit(0.0))


def js_round(col) -> Column:
    """Round half up towards positive infinity (-2.5 becomes -2)."""
    return F.floor(_c(col) + F.lit(0.5))


def round_half_up(col, digits: int) -> Column:
    return F.round(_c(col).cast("double"), digits)


def round_scaled(col, digits: int) -> Column:
    """Scale up, round half away from zero, scale down: the rounding of the score formulas."""
    factor = float(10**digits)
    return F.round(_c(col).cast("double") * factor) / factor


def to_fixed(col, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals and no grouping."""
    return F.format_string(f"%.{digits}f", _c(col).cast("double"))


#: Doubles below this magnitude are summed as integers; beyond it a double has no fraction to lose.
_WHOLE_LIMIT = float(1 << 52)


def exact_sum(col) -> Column:
    """Order-independent sum of a double column, as double.

    Floating sums depend on the order of partial results. Here every value below
    2**52 is cut into four integers of 26 or 27 bits (the upper and lower half of
    the whole part, and two of the fraction down to 2**-53), which are summed as
    longs: associative, so any partitioning gives the same bits, and the hash
    aggregate keeps numeric buffers. 10**11 rows fit before a long could overflow.

    What lies below 2**-53 (the tail of values under 0.5) and values of 2**52 and
    more are added as doubles beside it: nothing is rounded away or clamped, NaN
    and the infinities give what IEEE addition gives, and their order can matter
    only in the last bits of that part. Null values are skipped; a sum of nulls
    is null.
    """
    value = _c(col).cast("double")
    exact = F.abs(value) < F.lit(_WHOLE_LIMIT)  # false for NaN and the infinities
    kept = F.when(exact, value).when(value.isNotNull(), F.lit(0.0))
    whole = kept.cast("bigint")
    upper = F.shiftright(whole, 26)
    lower = whole.bitwiseAND(F.lit((1 << 26) - 1))
    fraction = (kept - whole) * float(1 << 26)
    first = fraction.cast("bigint")
    tail = (fraction - first) * float(1 << 27)
    second = tail.cast("bigint")
    rest = F.when(exact, (tail - second) / float(1 << 53)).otherwise(value)
    return (
        F.sum(upper).cast("double") * float(1 << 26)
        + F.sum(lower).cast("double")
        + (F.sum(first).cast("double") / float(1 << 26) + F.sum(second).cast("double") / float(1 << 53) + F.sum(rest))
    )


def exact_avg(col) -> Column:
    """Order-independent mean of the non-null values, as double."""
    value = _c(col)
    return F.try_divide(exact_sum(value), F.count(value).cast("double"))


def compact(col) -> Column:
    """1.2M / 3.4K / 56 for dashboard cards."""
    value = _c(col).cast("double")
    return (
        F.when(value >= 1_000_000, F.concat(to_fixed(value / 1_000_000, 1), F.lit("M")))
        .when(value >= 1_000, F.concat(to_fixed(value / 1_000, 1), F.lit("K")))
        .otherwise(plain_number(value))
    )


def compact_intl(col) -> Column:
    """English compact notation with at most one decimal: 1.2K, 3M, 4.5B."""
    value = _c(col).cast("double")
    magnitude = F.abs(value)

    def scaled(divisor: float, suffix: str) -> Column:
        return F.concat(plain_number(F.round(value / divisor, 1)), F.lit(suffix))

    return (
        F.when(magnitude >= 1e12, scaled(1e12, "T"))
        .when(magnitude >= 1e9, scaled(1e9, "B"))
        .when(magnitude >= 1e6, scaled(1e6, "M"))
        .when(magnitude >= 1e3, scaled(1e3, "K"))
        .otherwise(plain_number(F.round(value, 1)))
    )


def plain_number(col) -> Column:
    """Decimal text without exponent or trailing zeros (2.50 -> 2.5, 3.0 -> 3)."""
    text = F.format_string("%.6f", _c(col).cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def canonical_number(col) -> Column:
    """Number text for canonical JSON: the shortest digits that read back as the same double.

    Plain with at least one decimal from 1e-5 up to 1e16, with an exponent (1e19,
    1.5e-7) outside; null for null, NaN and the infinities, which JSON has no
    number for.
    """
    value = _c(col).cast("double")
    magnitude = F.abs(value)
    text = value.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    scientific = F.lower(F.regexp_replace(text, r"\.0E", "E"))
    return (
        F.when(value.isNull() | F.isnan(value) | (magnitude == float("inf")), F.lit("null"))
        .when(value == 0, F.lit("0.0"))  # decimal zero prints as 0E-21
        .when((magnitude >= 1e-5) & (magnitude < 1e16), plain)
        .otherwise(scientific)
    )


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
