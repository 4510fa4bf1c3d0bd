"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "razao", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small tables, all cores
        .config("spark.driver.memory", os.environ.get("RAZAO_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="razao-")


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only a local session, where driver and executors share a disk, may fall back to /tmp.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_scratch()


def materialize(df: DataFrame, label: str, root: str | None = None, parts: Sequence[Column | None] = (None,)) -> DataFrame:
    """Write a result that is used several times as a table on shared storage, and read it.

    Cuts the lineage: a lost executor costs a re-read, not a re-parse. A table in a work folder (`root`) is
    packed, and may be dropped by its label when it is not read any more (`discard`).
    """
    spark = df.sparkSession
    path = f"{root or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if root:
        write_packed(df, path, parts=parts)
    else:
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_packed(
    df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None,
    parts: Sequence[Column | None] = (None,), **options,
) -> None:
    """Write a table in few bytes (zstd), and leave no shuffle files behind.

    `parts` are filters that divide the rows: they are written one after the other, so that the shuffles of one
    alone lie on disk, at the price of reading the input for each.
    """
    with shuffles_removed(df.sparkSession):
        for i, part in enumerate(parts):
            rows = df if part is None else df.filter(part)
            writer = rows.write.mode("append" if i else mode).options(compression="zstd", **options)
            (writer.partitionBy(by) if by else writer).parquet(path)


def discard(spark: SparkSession, root: str | None, *labels: str) -> None:
    """Remove the tables of these labels from a work folder, where nothing that is still to run reads them."""
    if not root:  # the scratch folder is shared
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            if status.getPath().getName().rpartition("-")[0] in labels:
                fs.delete(status.getPath(), True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_LOCK, _UNDO, _writers = threading.Lock(), ExitStack(), 0


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes that run inside remove their shuffle files when they end, not when the driver's heap is next cleaned.

    Writers of several threads share the setting; the last one takes it back.
    """
    global _writers
    with _LOCK:
        if not _writers:
            _UNDO.enter_context(_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
        _writers += 1
    try:
        yield
    finally:
        with _LOCK:
            _writers -= 1
            if not _writers:
                _UNDO.close()


@contextmanager
def split_size(spark: SparkSession, split_bytes: str | None) -> Iterator[None]:
    """Scans that run inside take splits of at most this size; without one, as the session says."""
    if not split_bytes:
        yield
        return
    with _setting(spark, "spark.sql.files.maxPartitionBytes", split_bytes):
        yield
