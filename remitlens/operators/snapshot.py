"""Corridor snapshots, historical replay and snapshot digests.

Sums are order-independent, so a replay gives the same bytes for any partitioning
and any input order. Nothing here reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.errors import EmptyInput, InvalidRange
from remitlens.functions.accumulate import exact_totals
from remitlens.functions.numbers import canonical_number, safe_div
from remitlens.operators.scans import global_rank

# Fixed value: version text pinned into every payload.
MODEL_VERSION = "reliability-v2025.01"


def filter_ledger_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of an inclusive ledger range; the predicate reaches the file scan."""
    if start > end:
        raise InvalidRange(f"ledger range {start}..{end} is reversed")
    return rows.where(F.col("ledger_sequence").between(start, end))


def generate_snapshot(rows: DataFrame, by_network: bool = False, require_rows: bool = False) -> DataFrame:
    """One record per corridor.

    ``source`` is that of the lowest ledger row, the smaller source when a
    ledger has several. ``by_network`` keeps networks apart instead of merging
    them under one corridor.

    Sums are exact over the whole range of a double (``exact_totals``): the same
    bits for any partitioning and order of the rows. The big aggregate, per (corridor,
    source), keeps numeric buffers only, so it is hash-based and map-side; the source
    is picked among one row per corridor and source.
    """
    if require_rows and rows.isEmpty():
        raise EmptyInput("snapshot input is empty")
    values = ["reliability", "volume", "latency_ms"]
    parts = exact_totals(
        rows,
        ["corridor", "source"] if by_network else ["corridor"],
        values,
        {
            "_n": (F.count("reliability"), F.sum),
            "_m": (F.count("latency_ms"), F.sum),
            "_first": (F.min("ledger_sequence"), F.min, F.struct("_first", "source")),
        },
        within=() if by_network else ("source",),
    )
    return parts.select(
        "corridor",
        F.col("source") if by_network else F.col("_first.source").alias("source"),
        safe_div("reliability", "_n").alias("avg_reliability"),
        F.col("volume").alias("total_volume"),
        safe_div("latency_ms", "_m").alias("avg_latency_ms"),
    )


def record_json() -> Column:
    """Canonical JSON of one snapshot record: fixed key order, fixed number text."""
    fields = [
        F.concat(F.lit('"corridor":'), _json_text("corridor")),
        F.concat(F.lit('"source":'), _json_text("source")),
        F.concat(F.lit('"avg_reliability":'), canonical_number("avg_reliability")),
        F.concat(F.lit('"total_volume":'), canonical_number("total_volume")),
        F.concat(F.lit('"avg_latency_ms":'), canonical_number("avg_latency_ms")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _json_text(name: str) -> Column:
    # to_json of a one-element array quotes and escapes the text
    return F.regexp_replace(F.to_json(F.array(F.col(name))), r"^\[|\]$", "")


def payload_lines(snapshot: DataFrame) -> DataFrame:
    """The canonical payload in ordered lines (position, value): header, one record per row, footer.

    Joined without anything between them the lines are one JSON document, of any
    number of records. Records go by corridor and source in byte order; the
    separator leads every record but the first. Ordering and numbering are a range
    sort and partition offsets, so no task holds the snapshot.
    """
    ranked = global_rank(snapshot.select("corridor", "source", record_json().alias("json")), ["corridor", "source", "json"])
    records = ranked.select(F.col("rank").alias("position"), F.concat(F.when(F.col("rank") == 1, F.lit("")).otherwise(F.lit(",")), "json").alias("value"))
    frame = snapshot.sparkSession.createDataFrame([(0, '{"model_version":"' + MODEL_VERSION + '","records":[')], "position bigint, value string")
    footer = records.agg(F.coalesce(F.max("position"), F.lit(0)).alias("n")).select((F.col("n") + 1).alias("position"), F.lit("]}").alias("value"))
    return frame.unionByName(records).unionByName(footer)


def replay(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Snapshot records of a historical ledger range (no rows for an empty range)."""
    return generate_snapshot(filter_ledger_range(rows, start, end))


def replay_payload(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Lines of the canonical payload of a historical range; an empty range has a header and a footer."""
    return payload_lines(replay(rows, start, end))


def snapshot_digest(df: DataFrame, columns: list[str], snapshot_type: str) -> DataFrame:
    """Hash and record count of a snapshot, independent of row order.

    Every row is hashed on its own. The row hashes are added up in four 64-bit
    slices, which is associative, so no task ever holds the whole snapshot; the
    four sums and the count are hashed once more.
    """
    row_hash = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256)
    slices = [
        F.sum(F.conv(F.substring("_h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}") for i in range(4)
    ]
    return (
        df.select(row_hash.alias("_h"))
        .agg(F.count("*").alias("record_count"), *slices)
        .select(
            F.lit(snapshot_type).alias("snapshot_type"),
            "record_count",
            F.sha2(
                F.concat_ws(
                    "|",
                    F.col("record_count").cast("string"),
                    *[F.coalesce(F.col(f"_s{i}").cast("string"), F.lit("0")) for i in range(4)],
                ),
                256,
            ).alias("data_hash"),
        )
    )
