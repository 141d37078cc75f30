"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for.  Broadcast joins are never hinted: the size threshold and AQE's
#: measured shuffle sizes decide, so a dimension that outgrows the threshold falls back to a shuffle join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(app: str = "panelloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """A session with the engine's settings; cluster defaults are kept for everything not named here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local master may fall back to a temp folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="panelloom-"))
    return context.getCheckpointDir()


def new_scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/panelloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of the executors that computed it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint(eager=True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope: ContextVar[list[Scratch] | None] = ContextVar("scratch scope", default=None)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Everything kept by a ``Scratch`` made inside is deleted at the end: what is computed from it must be written by then."""
    made: list[Scratch] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for scratch in made:
            scratch.close()


_writes: dict[int, tuple[int, str]] = {}  # by session: writes that run, and the setting before the first of them
_writes_lock = Lock()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled is deleted when its table is there.  Of several writes at the same time the last one restores the setting."""
    session = spark._jsparkSession.hashCode()
    with _writes_lock:
        running, before = _writes.get(session, (0, ""))
        if not running:
            before = spark.conf.get(SHUFFLE_CLEANUP, "false")
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _writes[session] = running + 1, before
    try:
        yield
    finally:
        with _writes_lock:
            running, before = _writes.pop(session)
            if running > 1:
                _writes[session] = running - 1, before
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Intermediate tables of one job, as Parquet in a folder of their own below the shared one.

    ``keep`` writes a table and reads it back, so a lost executor costs no more than what has run since; ``drop`` deletes tables
    nothing reads any more, ``close`` the whole folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self._taken = spark, new_scratch(spark, label), 0
        if (scope := _scope.get()) is not None:
            scope.append(self)

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        self._taken += 1
        path = f"{self.folder}/{self._taken}-{name}"
        with shuffles_deleted(self.spark):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove_folder(self.spark, table._scratch_path)

    def close(self) -> None:
        remove_folder(self.spark, self.folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system its path names; one that is gone already is no error."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
