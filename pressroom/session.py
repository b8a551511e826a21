"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pressroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Crawled pages are large rows: bound an Arrow batch by bytes as well as by rows.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Pin the two settings results depend on, for sessions built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, for operators with Python tasks."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="pressroom-code-")) / package.name
        archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="pressroom-")


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside the block are removed at its end.

    Wrap it around the building of a frame and the action that consumes it: a scheduled driver then
    leaves nothing in the shared folder between its runs. Without it they go when the application ends.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_scratch()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that runs in the block go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


_settled: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Remove settled tables, before their scope ends, that neither the caller nor a frame given out reads again."""
    for df in frames:
        path = _settled.pop(df, None)
        if path:
            _remove(df.sparkSession, path)


def settle(df: DataFrame, name: str, by: Sequence[str] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in a folder for each value of ``by``, and read it back.

    Cuts the lineage at a durable table: a lost executor re-reads files instead of recomputing
    a non-deterministic or expensive plan, and later scans see real sizes and pruned columns.
    The table is removed by ``discard``, at the end of the surrounding ``scratch``, else when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with tidy(spark):
        df.write.mode("errorifexists").partitionBy(*by).parquet(path, compression=codec)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(path)
    _settled[table] = path
    return table


def give_back() -> None:
    """Hand memory that is not in use to the system: Arrow's, and the C library's where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


SPREAD_SETTING = "spark.pressroom.spreadTasks"


def spread(df: DataFrame) -> DataFrame:
    """Deal the input of CPU-heavy work to as many tasks as ``spark.pressroom.spreadTasks`` says.

    Unset, as it should be on data of any size, rows stay where they are read. A user whose files are
    single row groups, which Spark cannot split, sets it for the session.
    """
    tasks = df.sparkSession.conf.get(SPREAD_SETTING, None)
    return df.repartition(int(tasks)) if tasks and not df.isStreaming else df
