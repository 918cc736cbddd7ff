"""Exact sums of doubles over their whole range, by exponent bins.

A double is cut into limbs of 24 bits, each a whole multiple of a power 2**(24 k);
limbs of one bin k are added up as longs, so any order and any partitioning gives
the same bins: 2**35 rows and more fit before a long could overflow. Carries are
taken once, at the end, and the bins become one double.

Values between 2**-20 and 2**52 (and zero) have the same five bins, which makes
five plain sums. Rows that hold others are grouped by their own top bin beside
them. The big aggregate therefore stays hash-based and map-side; what follows works
on one row per group and top bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
_UNIT = float(1 << BITS)
_MASK = (1 << BITS) - 1
_LIMBS = 5
_LEAST, _MOST = 2.0**-20, 2.0**52


def top_bin(value: Column) -> Column:
    """Bin of the first limb of a value outside the common range; null inside it, for null, NaN and the infinities."""
    size = F.abs(value)
    rare = (size > 0) & (size < float("inf")) & ~((size >= _LEAST) & (size < _MOST))
    return F.when(rare, F.floor(F.log2(size) / BITS).cast("int"))


def limbs(value: Column, top: Column) -> list[Column]:
    """Five longs whose bins fall from ``top`` (from 1 where it is null); 0 for NaN and the infinities, null for null."""
    finite = F.abs(value) < float("inf")
    kept = F.when(finite, value).when(value.isNotNull(), F.lit(0.0))
    # scaled in two steps, so that neither leaves the range of a double
    half = F.pow(F.lit(2.0), F.coalesce(top, F.lit(0)) * F.lit(-BITS // 2))
    scaled = kept * half * half
    whole = scaled.cast("bigint")
    out = [F.when(top.isNull(), F.shiftright(whole, BITS)).otherwise(whole), F.when(top.isNull(), whole.bitwiseAND(F.lit(_MASK)))]
    rest, fractions = scaled - whole, []
    for _ in range(4):
        rest = rest * _UNIT
        limb = rest.cast("bigint")
        fractions.append(limb)
        rest = rest - limb
    # 53 bits below the first of a rare value end within its third fraction
    common, rare = [*out, *fractions[:3]], [out[0], *fractions]
    return [out[0]] + [F.when(top.isNull(), a).otherwise(b) for a, b in zip(common[1:], rare[1:])]


def special(value: Column) -> Column:
    """NaN and the infinities alone: their sum does not depend on the order."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), value)


def _fold(bins: Column, sign: int) -> Column:
    """(carry, r, k) of ``sign`` times the bins: digits are taken from the lowest bin up, the value is r * 2**(24 k)."""
    keys = F.map_keys(bins)
    first, last = F.array_min(keys), F.array_max(keys) + 4  # a carry of 63 bits has three digits more
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(0.0).alias("r"), first.alias("k"))

    def step(state, k):
        x = F.coalesce(F.try_element_at(bins, k), F.lit(0)) * sign + state["carry"]
        digit = x.bitwiseAND(F.lit(_MASK))
        shifted = state["r"] * F.pow(F.lit(2.0), (state["k"] - k) * BITS) + digit
        return F.struct(
            F.shiftright(x, BITS).alias("carry"), F.when(digit == 0, state["r"]).otherwise(shifted).alias("r"),
            F.when(digit == 0, state["k"]).otherwise(k).alias("k"),
        )

    return F.aggregate(F.sequence(first, last), start, step)


def total(bins: Column) -> Column:
    """Double of a map from bin to long; 0 for an empty map."""
    up, down = _fold(bins, 1), _fold(bins, -1)

    def value(state):
        half = F.pow(F.lit(2.0), state["k"] * F.lit(BITS // 2))
        return state["r"] * half * half

    return F.when(F.size(bins) == 0, F.lit(0.0)).when(up["carry"] < 0, -value(down)).otherwise(value(up))


def exact_totals(
    rows: DataFrame, keys: list[str], values: list[str], measures: dict[str, tuple], within: tuple[str, ...] = ()
) -> DataFrame:
    """Per key the exact sum of every column of ``values``, and further measures.

    ``measures`` gives, by name, an aggregate over the rows and the function that
    merges its partial results (``F.sum``, ``F.min`` ...). With ``within`` the rows are
    first reduced per key and these columns; a third entry of a measure is then a
    column over them that takes the place of the partial result. Nulls are skipped; a
    sum of nulls is null; NaN and the infinities give what IEEE addition gives. A sum
    beyond the range of a double is infinite.
    """
    typed = rows.withColumns({v: F.col(v).cast("double") for v in values})
    tops = typed.withColumns({f"_top_{i}": top_bin(F.col(v)) for i, v in enumerate(values)})
    sums = [F.sum(limb).alias(f"_s_{i}_{j}") for i, v in enumerate(values) for j, limb in enumerate(limbs(F.col(v), F.col(f"_top_{i}")))]
    odd = [F.sum(special(F.col(v))).alias(f"_odd_{i}") for i, v in enumerate(values)]
    parts = tops.groupBy(*keys, *within, *[f"_top_{i}" for i in range(len(values))]).agg(*sums, *odd, *[m[0].alias(n) for n, m in measures.items()])
    parts = parts.withColumns({n: m[2] for n, m in measures.items() if len(m) > 2})
    # the first line of a part carries its other measures
    kept = [*measures, *[f"_odd_{i}" for i in range(len(values))]]
    lines = [
        F.struct(
            F.lit(i).alias("_which"), (F.coalesce(F.col(f"_top_{i}"), F.lit(1)) - j).alias("_bin"), F.col(f"_s_{i}_{j}").alias("_sum"),
            *[(F.col(c) if i == j == 0 else F.when(F.lit(False), F.col(c))).alias(c) for c in kept],
        )
        for i in range(len(values))
        for j in range(_LIMBS)
    ]
    merged = [m[1](F.col(n)).alias(n) for n, m in measures.items()] + [F.sum(f"_odd_{i}").alias(f"_odd_{i}") for i in range(len(values))]
    bins = parts.select(*keys, F.inline(F.array(*lines))).groupBy(*keys, "_which", "_bin").agg(F.sum("_sum").alias("_sum"), *merged)
    # at most 93 bins per value
    own = lambda i: F.collect_list(F.when((F.col("_which") == i) & F.col("_sum").isNotNull(), F.struct("_bin", "_sum"))).alias(f"_bins_{i}")
    whole = bins.groupBy(*keys).agg(*[own(i) for i in range(len(values))], *merged)
    sums_of = {
        v: F.coalesce(F.col(f"_odd_{i}"), F.when(F.size(f"_bins_{i}") > 0, total(F.map_from_entries(f"_bins_{i}")))) for i, v in enumerate(values)
    }
    return whole.select(*keys, *[c.alias(v) for v, c in sums_of.items()], *measures)
