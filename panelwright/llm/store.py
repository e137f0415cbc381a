"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import RLock

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 8 << 20
_own_folder: list[str] = []
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())  # of the running query: threads have their own


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the folder given to ``setCheckpointDir``.

    Only a local session without either gets a folder of our own; on a cluster a folder of one
    machine would lose the rows of all others, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-llm-"))
    return "file://" + _own_folder[0]


_changed: dict[tuple[int, str], list] = {}
_lock = RLock()


@contextmanager
def _conf(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option for a while. Queries of several threads may hold it at once: the first sets it, the last puts back what was there."""
    key = (id(spark), name)
    with _lock:
        if key not in _changed:
            _changed[key] = [0, spark.conf.get(name, None)]
            spark.conf.set(name, value)
        _changed[key][0] += 1
    try:
        yield
    finally:
        with _lock:
            _changed[key][0] -= 1
            if not _changed[key][0]:
                before = _changed.pop(key)[1]
                if before is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, before)


def frozen(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back.

    Cuts lineage like ``checkpoint()``, but compressed and columnar. Values made from
    ``monotonically_increasing_id`` or a range partitioning are fixed from here on, whatever
    executors are lost later. The shuffle files of the write are dropped as soon as it has ended.
    Arrow batches of Python steps in the write are bounded by bytes, as ten thousand long texts
    would not fit a worker.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _conf(spark, _CLEANUP, "true"), _conf(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.frozen_path = path
    _noted(table)
    return table


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` as a table of sorted buckets of ``key`` in the shared folder: joins of two such tables need no exchange.

    A ``df`` that comes out of an aggregation or join on ``key`` has whole buckets in a task already; one
    that does not is dealt by the caller.
    """
    spark = df.sparkSession
    n = tasks(spark)
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with _conf(spark, _CLEANUP, "true"), _conf(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.frozen_path, table.table_name = path, name
    _noted(table)
    return table


def _noted(table: DataFrame) -> None:
    if _open.get():
        _open.get()[-1].append(table)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """All tables written inside go at the end, but those put into the list that this gives."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _open.set((*_open.get(), made))
    try:
        yield kept
    finally:
        _open.reset(token)
        release(*(t for t in made if t.frozen_path not in {k.frozen_path for k in kept}))
        for table in kept:
            _noted(table)


def release(*tables: DataFrame | None) -> None:
    """Delete tables written by :func:`frozen` or :func:`bucketed` once nothing that is still to be computed reads them."""
    for table in tables:
        if table is None:
            continue
        if hasattr(table, "table_name"):
            table.sparkSession.sql(f"drop table if exists {table.table_name}")
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.frozen_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for steps that compute much on few bytes, which the adaptive planner would put into too few tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_texts(df: DataFrame) -> DataFrame:
    """``df``, for a Python step over whole texts that the caller runs: the session's Arrow batches are bounded by bytes from here on.

    A result is computed only when its reader asks for it, so the bound has to outlive the call.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def trim() -> None:
    """Give memory that a Python worker has freed back to the system: an idle worker is kept, and would keep it from the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns that Spark can hash (maps are left out)."""
    names = [f"`{name}`" for name, kind in df.dtypes if not kind.startswith("map")]
    return F.xxhash64(*[F.col(name) for name in names])


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that carry the names an operator is about to add."""
    taken = {name.lower() for name in names}
    return df.drop(*[name for name in df.columns if name.lower() in taken])
