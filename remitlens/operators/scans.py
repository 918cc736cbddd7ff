"""Ordered scans that split long groups into blocks.

A plain window over a key puts the whole key into one task. These helpers cut
each key into blocks along the order column: block summaries are aggregated
map-side, carried from block to block over the (few) summary rows, and joined
back on (key, block). The join and the inner window share one hash partitioning,
so the data is shuffled once, and a hot key is spread over its blocks.

Key and block travel as one struct. Structs with equal null fields are equal, so
rows with a null key form a group of their own, as in a window, and rows with a
null order value form the first block of their key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)
#: Rows that a block should hold on average.
ROWS_PER_BLOCK = 200_000
#: Quantiles of the order column that blocks are made of; a power of two.
_CUTS = 4096


def time_block(ts, seconds: int) -> Column:
    """Block number of a timestamp column, blocks of a fixed length."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(col.cast("timestamp")) / F.lit(seconds))


def number_block(order: str, width: int) -> Column:
    """Block number of a numeric column, blocks of a fixed width."""
    return F.floor(F.col(order) / F.lit(width))


def even_block(df: DataFrame, order: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """Block number of evenly spread values, whose width follows the data: so many blocks between the least and
    the greatest order value that they hold ``rows_per_block`` rows on average.

    The bounds are a scalar subquery (one map-side aggregate); nothing reaches the
    driver. Few rows make one block, however sparse their numbers are.
    """
    timed = df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    place = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order)
    place = place.cast("double")
    bounds = df.select(place.alias("x")).agg(
        F.struct(F.min("x").alias("low"), F.max("x").alias("high"), F.ceil(F.count("*") / F.lit(rows_per_block)).alias("n")).alias("b")
    ).scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    share = F.when(high > low, (place - low) / (high - low)).when(place.isNotNull(), F.lit(0.0))
    return F.floor(share * bounds.getField("n"))


@dataclass
class QuantileBlocks:
    """Blocks by quantiles of a number column; ``sketch`` is a scalar subquery."""

    place: Column
    sketch: Column

    def added(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the block number of each row; null where the order value is."""
        # the sketch becomes a column first, as no subquery may stand inside a lambda
        placed = df.withColumn("_sketch", self.sketch).withColumn("_place", self.place)
        cuts, n = F.col("_sketch.cuts"), F.col("_sketch.n")
        steps = F.array(*[F.lit(_CUTS >> k) for k in range(1, _CUTS.bit_length())])
        passed = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) <= F.col("_place"), at + step).otherwise(at))
        number = F.when(n > 1, F.floor(passed * F.least(n, F.lit(_CUTS)) / _CUTS)).otherwise(F.lit(0).cast("bigint"))
        return placed.withColumn(out, F.when(F.col("_place").isNotNull(), number)).drop("_sketch", "_place")


def quantile_blocks(df: DataFrame, order: str, rows_per_block: int = ROWS_PER_BLOCK) -> QuantileBlocks:
    """Blocks by sampled quantiles of the order column, so many that they hold ``rows_per_block`` rows on average.

    A sketch of the order values (one map-side aggregate; nothing reaches the driver)
    gives 4095 cut points. Outliers and clusters don't matter: blocks follow the rank
    of a row, not its value, and a key has no more rows in a block than all keys
    together. Only rows of one order value stay together. A row finds its place among
    the cuts by binary search. Few rows make one block.
    """
    timed = df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    place = (F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order)).cast("double")
    points = [i / _CUTS for i in range(1, _CUTS)]
    sketch = df.select(place.alias("x")).agg(
        F.struct(F.percentile_approx("x", points, 10 * _CUTS).alias("cuts"), F.ceil(F.count("*") / F.lit(rows_per_block)).alias("n")).alias("b")
    )
    return QuantileBlocks(place, sketch.scalar())


def _blocked(df: DataFrame, keys: list[str], block: Column | QuantileBlocks) -> DataFrame:
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    if isinstance(block, QuantileBlocks):
        return block.added(df, "_block").withColumn("_key", F.struct(key.alias("key"), F.col("_block").alias("block"))).drop("_block")
    return df.withColumn("_key", F.struct(key.alias("key"), block.alias("block")))


def _carried(summary: DataFrame, value: Column) -> DataFrame:
    """(_key, _carry): ``value`` evaluated over the earlier blocks of the key."""
    return summary.select("_key", value.alias("_carry"))


def _blocks_before(frame: bool = True):
    by_key = Window.partitionBy("_key.key").orderBy("_key.block")
    return by_key.rowsBetween(*_BEFORE) if frame else by_key


def previous_max(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column | QuantileBlocks, out: str) -> DataFrame:
    """Largest ``value`` among the rows of the key that come before this one."""
    blocked = _blocked(df, keys, block)
    carry = _carried(blocked.groupBy("_key").agg(F.max(value).alias("_top")), F.max("_top").over(_blocks_before()))
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(*_BEFORE)
    return (
        blocked.join(carry, "_key")
        .withColumn(out, F.greatest(F.max(value).over(inside), F.col("_carry")))
        .drop("_key", "_carry")
    )


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], block: Column | QuantileBlocks, out: str
) -> DataFrame:
    """Struct of ``values`` of the preceding row of the key, null on the first row."""
    blocked = _blocked(df, keys, block).withColumn("_row", F.struct(*values))
    last = blocked.groupBy("_key").agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    carry = _carried(last, F.lag("_last").over(_blocks_before(frame=False)))
    inside = Window.partitionBy("_key").orderBy(*order)
    return (
        blocked.join(carry, "_key")
        .withColumn(out, F.coalesce(F.lag("_row").over(inside), F.col("_carry")))
        .drop("_key", "_carry", "_row")
    )


def neighbours(df: DataFrame, keys: list[str], value: str, block: Column | QuantileBlocks, previous: str, following: str) -> DataFrame:
    """The next smaller and the next larger ``value`` of the key, for distinct values, in one scan; a null value has neither."""
    blocked = _blocked(df, keys, block)
    ends = blocked.groupBy("_key").agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    by_block = _blocks_before(frame=False)
    carry = ends.select("_key", F.lag("_most").over(by_block).alias("_before"), F.lead("_least").over(by_block).alias("_after"))
    inside = Window.partitionBy("_key").orderBy(value)
    return (
        blocked.join(carry, "_key")
        .withColumn(previous, F.coalesce(F.lag(value).over(inside), F.col("_before")))
        .withColumn(following, F.when(F.col(value).isNotNull(), F.coalesce(F.lead(value).over(inside), F.col("_after"))))
        .drop("_key", "_before", "_after")
    )


def previous_two(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column | QuantileBlocks, last: str, before: str) -> DataFrame:
    """``value`` of the preceding row of the key and of the row before that, in one scan."""
    blocked = _blocked(df, keys, block)
    inside = Window.partitionBy("_key").orderBy(*order)
    # the limit also runs before the shuffle: two rows per block and task
    newest = Window.partitionBy("_key").orderBy(*[F.desc(c) for c in order])
    ends = (
        blocked.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 2")
        .groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_rn"), value))), lambda r: r[value]).alias("_ends"))
    )
    none = F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    earlier = F.concat(*[F.coalesce(F.lag("_ends", n).over(_blocks_before(frame=False)), none) for n in (2, 1)])
    placed = blocked.join(_carried(ends, earlier), "_key").withColumn("_nth", F.row_number().over(inside))
    carried = lambda n: F.try_element_at("_carry", F.lit(-n))
    return (
        placed.withColumn(last, F.when(F.col("_nth") == 1, carried(1)).otherwise(F.lag(value, 1).over(inside)))
        .withColumn(before, F.when(F.col("_nth") == 1, carried(2)).when(F.col("_nth") == 2, carried(1)).otherwise(F.lag(value, 2).over(inside)))
        .drop("_key", "_carry", "_nth")
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column | QuantileBlocks, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    blocked = _blocked(df, keys, block)
    carry = _carried(blocked.groupBy("_key").agg(F.sum(value).alias("_part")), F.sum("_part").over(_blocks_before()))
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(carry, "_key")
        .withColumn(out, F.sum(value).over(inside) + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_key", "_carry")
    )


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Row number over the whole frame without gathering it in one task.

    The frame is range-sorted once and pinned with a durable checkpoint. Each
    row then knows its partition and its place in it; partition sizes (one row
    per partition) give the offset.
    """
    from remitlens.session import durable_checkpoint

    pinned = durable_checkpoint(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    placed = pinned.select(
        "*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")
    )
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition of the sort
        .withColumn(out, F.col("_offset") + F.col("_pos") + 1)
        .drop("_id", "_part", "_pos", "_offset")
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], weight: str | None = None) -> DataFrame:
    """Interpolated percentiles per key, exact, for groups of any size.

    Values are first reduced to (key, value, frequency), which splits a hot key
    over its values. Cumulative frequencies come from a two-level scan (value
    ranges of the key, then values inside a range), and each percentile picks
    the two values around its position. The range sums that are carried also give
    the total of the key. ``weight`` is a column of frequencies, for rows that are
    counted already; these are not grouped again.
    """
    if weight:
        counted = df.where(F.col(value).isNotNull()).select(*keys, value, F.col(weight).alias("_n"))
    else:
        counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # Order-preserving range number: 64 ranges per power of two of the magnitude, however small it is.
    magnitude = F.floor(F.log2(F.abs(F.col(value).cast("double"))) * 64) + 1100 * 64
    block = F.when(F.col(value) == 0, F.lit(0)).otherwise(F.signum(F.col(value).cast("double")).cast("bigint") * magnitude)
    blocked = _blocked(counted, keys, block)
    parts = blocked.groupBy("_key").agg(F.sum("_n").alias("_part"))
    carry = parts.select(
        "_key", F.coalesce(F.sum("_part").over(_blocks_before()), F.lit(0)).alias("_carry"),
        F.sum("_part").over(Window.partitionBy("_key.key")).alias("_total"),
    )
    inside = Window.partitionBy("_key").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = blocked.join(carry, "_key").withColumn("_upto", F.sum("_n").over(inside) + F.col("_carry"))
    exprs = []
    for name, p in points.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        lower, upper = F.floor(position), F.ceil(position)
        first = F.col("_upto") - F.col("_n")

        def holds(index):
            return (first <= index) & (index < F.col("_upto"))

        low = F.max(F.when(holds(lower), F.col(value).cast("double")))
        high = F.max(F.when(holds(upper), F.col(value).cast("double")))
        weight = F.max(position - lower)
        exprs.append((low + (high - low) * weight).alias(name))
    return ranked.groupBy(*keys).agg(*exprs)
