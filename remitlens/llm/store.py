"""Shared storage and batch bounds for the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from remitlens import session


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, also set as the context's checkpoint folder.

    A cluster must name one; a local session that names none (a test) gets its own.
    """
    root = session.shared_dir(spark).rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def pinned(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    repeating the work before. The folder (``<shared>/llm/<label>-<id>``) stays
    until the results that read it are written; remove it afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def pinned_rows(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow frame; Spark's cleaner removes its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def prepare(spark: SparkSession, batch_bytes: str = "8m") -> None:
    """Set up a session for the Python tasks of this package; results don't depend on it.

    Sends this package to the executors once per application, so that they need
    no install of their own, and bounds the bytes of an Arrow batch, so that long
    texts do not add up in a Python worker. A bound that the session was started
    with stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    context = spark.sparkContext
    if not context.getConf().contains(key):
        spark.conf.set(key, batch_bytes)
    if _SENT.get("to") != context.applicationId:
        context.addPyFile(_package_zip())
        _SENT["to"] = context.applicationId


_SENT: dict[str, str] = {}


def _package_zip() -> str:
    """Zip of the library for ``addPyFile``, made on the driver; Spark serves it to the executors."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="llm-package-"), "remitlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    return path
