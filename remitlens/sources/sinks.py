"""Writers. Partitioned output is rebalanced by its partition columns first: tasks are
split and merged by bytes at run time, so a small partition is one file and a hot one
as many files of the advised size as it needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitlens.errors import BadEvent
from remitlens.functions.numbers import to_fixed
from remitlens.operators.snapshot import payload_lines


def export_columns(df: DataFrame, columns: dict[str, str], rate_is_fraction: bool = True) -> DataFrame:
    """Chosen columns under their labels as export text.

    ``date`` prints to the second, ``success_rate`` as a percentage with two
    decimals, null as empty text. The CSV writer quotes what needs quoting.
    """

    def cell(name: str) -> Column:
        col = F.col(name)
        if name == "date":
            return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        if name == "success_rate" and df.schema[name].dataType.typeName() in ("double", "float", "decimal"):
            return F.concat(to_fixed(col * 100 if rate_is_fraction else col, 2), F.lit("%"))
        return col.cast("string")

    return df.select(*[F.coalesce(cell(name), F.lit("")).alias(label) for name, label in columns.items()])


def export_csv(df: DataFrame, columns: dict[str, str], path: str, **options) -> None:
    export_columns(df, columns, **options).write.option("header", "true").option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def export_json(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*columns).write.mode("overwrite").json(path)


def snapshot_lines(snapshot: DataFrame) -> DataFrame:
    """The canonical payload as ordered text lines; the lines of all part files in order are one JSON document."""
    return payload_lines(snapshot).orderBy("position").select("value")


def write_snapshot_payload(snapshot: DataFrame, path: str) -> None:
    snapshot_lines(snapshot).write.mode("overwrite").text(path)


def _spread(df: DataFrame, partition: str, files: int | None) -> DataFrame:
    """Tasks of about the session's advised partition size, or ``files`` tasks per partition value where that is asked for.

    A small value that shares a shuffle partition with a hot one is split with it.
    """
    if files is None:
        return df.hint("rebalance", partition)
    return df.repartition(partition, F.pmod(F.xxhash64(*df.columns), F.lit(files)))


def _replace_parts(df: DataFrame, path: str, *partitions: str) -> None:
    """Write partitions; those that the frame has replace their old content, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_metrics(df: DataFrame, path: str, batch_id: int = 0, files_per_network: int | None = None) -> None:
    """Add a batch to the network-partitioned store.

    The batch number is a partition below the network, so a repeated batch replaces itself.
    """
    _replace_parts(_spread(df, "network", files_per_network).withColumn("batch", F.lit(batch_id)), path, "network", "batch")


def route_logs(logs: DataFrame, path: str, batch_id: int = 0, files_per_day: int | None = None) -> None:
    """All documents by day, and the error documents once more by day.

    The layout is ``<all or errors>/log_date=.../batch=...``: retention drops days, and a
    repeated batch replaces its own output.
    """
    dated = logs.withColumn("log_date", F.to_date("event_time"))
    errors = dated.where(F.array_contains("tags", "error"))
    for name, rows in (("all", dated), ("errors", errors)):
        _replace_parts(_spread(rows, "log_date", files_per_day).withColumn("batch", F.lit(batch_id)), f"{path}/{name}", "log_date", "batch")


def write_normalized_events(
    decoded: DataFrame, sink: Callable[[DataFrame], None], quarantine: Callable[[DataFrame], None], mode: str = "quarantine"
) -> None:
    """Hand valid events to the sink and the rest to the quarantine.

    ``failfast`` stops at the first bad event: events before it are written,
    then the batch fails. An error raised by the sink fails the batch too. For
    parts that become visible together, give sinks of one ``commits.batch``.
    """
    from remitlens.operators.contract_events import normalized, rejected

    # both sinks read one decoding, without its envelopes; what is lost is decoded again
    decoded = decoded.select("error", *normalized(decoded).columns).persist()
    try:
        bad = rejected(decoded)
        if mode == "failfast":
            first = bad.agg(F.min_by(F.struct("seq", "error_code"), "seq").alias("r")).first()["r"]
            if first is not None:
                sink(normalized(decoded.where(F.col("seq") < first["seq"])))
                raise BadEvent(f"event {first['seq']}: {first['error_code']}")
        sink(normalized(decoded))
        quarantine(bad)
    finally:
        decoded.unpersist()


def apply_retention(spark, path: str, as_of, column: str = "log_date") -> list[str]:
    """Delete the partitions of a day-partitioned table that are due, by metadata only.

    Lists partition directories through the table's own file system and never reads a row.
    """
    from datetime import date

    from remitlens.operators.logs import RETENTION

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit, removed = RETENTION[0][0], []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{column}="):
            day = date.fromisoformat(name.split("=", 1)[1])
            if (as_of.date() - day).days >= limit:
                fs.delete(status.getPath(), True)
                removed.append(name)
    return sorted(removed)
