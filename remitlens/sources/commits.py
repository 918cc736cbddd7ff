"""A store whose batches become visible at once, and from which users can be erased by file.

A batch stages its files under a folder of its own attempt. Only when all of its parts
are written is one small commit file put in place, by an atomic rename, that names them.
Readers open what the commits name, so a batch that fails between two parts shows
neither, and an attempt that was left half done is never read. A batch that runs again
puts its own commit file in the place of the old one.

``<path>/data/<part>/<batch>/<attempt>/...`` holds the files, ``<path>/commits/<batch>``
one line of JSON per file that the commit adds or takes away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LINES = "action string, part string, file string"


class Files:
    """The store's own file system; only names and small commit files pass the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.at(self.path).getFileSystem(self._conf)

    def at(self, path: str):
        return self._hadoop.Path(path)

    def listed(self, folder: str) -> list[str]:
        """Data files below ``folder``, relative to the store."""
        root = self._fs.makeQualified(self.at(self.path)).toString()
        found, files = [], self._fs.listFiles(self.at(folder), True)
        while files.hasNext():
            place = files.next().getPath()
            if not place.getName().startswith(("_", ".")):
                found.append(place.toString()[len(root) + 1 :])
        return sorted(found)

    def put(self, name: str, text: str) -> None:
        """Write ``<path>/<name>`` whole or not at all, in the place of an older one."""
        place, staged = self.at(f"{self.path}/{name}"), self.at(f"{self.path}/_staged/{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.mkdirs(place.getParent())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(place), options)

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(f"{self.path}/{name}"), True)

    def has(self, name: str) -> bool:
        return self._fs.exists(self.at(f"{self.path}/{name}"))


def _commit(files: Files, name: str, lines: list[tuple[str, str, str]]) -> None:
    body = "".join(json.dumps({"action": a, "part": p, "file": f}) + "\n" for a, p, f in lines)
    files.put(f"commits/{name}", body)


class Batch:
    """One attempt at a batch; ``part(name)`` is a sink that stages what it is given."""

    def __init__(self, files: Files, batch_id):
        self._files, self.batch_id, self._attempt = files, str(batch_id), uuid.uuid4().hex
        self.parts: list[str] = []

    def folder(self, part: str) -> str:
        return f"data/{part}/{self.batch_id}/{self._attempt}"

    def part(self, name: str) -> Callable[[DataFrame], None]:
        def stage(rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{self._files.path}/{self.folder(name)}")
            self.parts.append(name)

        return stage

    def staged(self) -> list[tuple[str, str]]:
        return [(p, f) for p in self.parts for f in self._files.listed(f"{self._files.path}/{self.folder(p)}")]


@contextmanager
def batch(spark: SparkSession, path: str, batch_id) -> Iterator[Batch]:
    """``with batch(spark, path, 7) as b: write(b.part("events"), b.part("quarantine"))``.

    The parts become visible together when the block ends. An error in the block takes
    the staged files away, leaves an earlier commit of the batch as it was and goes on up.
    """
    files = Files(spark, path)
    attempt = Batch(files, batch_id)
    try:
        yield attempt
        added = [("add", p, f) for p, f in attempt.staged()]
    except BaseException:
        for part in attempt.parts:
            files.remove(attempt.folder(part))
        raise
    _commit(files, attempt.batch_id, added)


def _state(spark: SparkSession, path: str, part: str) -> tuple[list[str], list[str]]:
    """(files in force, files taken away); one line per file reaches the driver, as a scan's own listing does."""
    files = Files(spark, path)
    if not files.has("commits"):
        return [], []
    lines = spark.read.schema(_LINES).json(f"{files.path}/commits").where(F.col("part") == part)
    state = lines.groupBy("file").agg(F.bool_or(F.col("action") == "remove").alias("gone")).collect()
    return sorted(r.file for r in state if not r.gone), sorted(r.file for r in state if r.gone)


def live_files(spark: SparkSession, path: str, part: str) -> list[str]:
    """Files of a part that the commits name, relative to the store."""
    return _state(spark, path, part)[0]


def read(spark: SparkSession, path: str, part: str, schema: str | StructType) -> DataFrame:
    """Rows of all committed batches of a part; none before the first commit."""
    live = live_files(spark, path, part)
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in live])


def erase_users(spark: SparkSession, path: str, part: str, schema: str | StructType, users: DataFrame, key: str = "user_id") -> list[str]:
    """Take the rows of ``users`` out of a part by rewriting the files that hold any of them.

    A narrow scan of the key finds these files; only they are read whole and written anew,
    all others keep their names and bytes. One commit exchanges old files for new, so a
    reader sees the part before or after, and the old files are deleted once it stands.
    A null key is no user. An erasure that runs again deletes what one that was stopped
    left lying. Returns the files that were exchanged.
    """
    files, root = Files(spark, path), path.rstrip("/")
    gone = users.select(F.col(key).alias(key)).where(F.col(key).isNotNull()).distinct()
    live, removed = _state(spark, path, part)
    for f in removed:
        files.remove(f)
    if not live:
        return []
    # a file's own name is unique and free of the escapes that a URI has
    scan = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in live]).select(key, F.col("_metadata.file_name").alias("_file"))
    held = {r["_file"] for r in scan.join(gone, key, "left_semi").select("_file").distinct().collect()}
    old = [f for f in live if f.rsplit("/", 1)[-1] in held]
    if not old:
        return []
    attempt = Batch(files, f"erase-{uuid.uuid4().hex}")
    rows = spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in old])
    attempt.part(part)(rows.join(gone, key, "left_anti").select(*rows.columns))
    _commit(files, attempt.batch_id, [("remove", part, f) for f in old] + [("add", p, f) for p, f in attempt.staged()])
    for f in old:
        files.remove(f)
    return old
