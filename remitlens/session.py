"""Session defaults and the few cluster settings the library reads."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from remitlens.errors import MissingSharedFolder


def build_session(app_name: str = "remitlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, ANSI on, AQE with skew-join handling.

    Sessions are merged map-side before the shuffle, so a hot account sends one
    row per session and task instead of one row per event.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def durable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; see ``shared_dir``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    A local session that names none (a test) gets a folder of its own; on a
    cluster that is an error, since a machine-local folder would lose rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise MissingSharedFolder("name a shared folder in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="remitlens-shared-")
