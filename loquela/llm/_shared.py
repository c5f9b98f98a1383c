"""What the operators of this package have in common: the shared folder, lineage cuts, tidy tasks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a run's shuffle files when the run ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that this process made and has not removed, with their sessions.
_folders: dict[str, SparkSession] = {}
#: The folders made inside settled(), for each thread.
_inside: ContextVar[list[str] | None] = ContextVar("_inside", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Only on a single machine (a local master, as in tests) is a local folder chosen where that
    setting is absent; on a cluster its absence is an error. The folder goes when it is dropped,
    at the latest when the driver's process ends: results that read it are lazy.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loquela-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/loquela-{uuid.uuid4().hex}"
    _folders[folder] = spark
    if (inside := _inside.get()) is not None:
        inside.append(folder)
    return folder


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows, computed once and kept as Parquet in the shared folder.

    Cuts the lineage: an executor lost later costs no recomputation of what came before. The
    shuffle files of the run go with it, not when the driver's collector finds them some time.
    """
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.mode("overwrite").parquet(folder)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder made by written(), through the Hadoop file system of its URI."""
    _folders.pop(uri, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], folder: str) -> DataFrame:
    """written(make(), folder), and the folders that make() left on the way are gone."""
    token = _inside.set([])
    try:
        return written(make(), folder)
    finally:
        made = _inside.get()
        _inside.reset(token)
        for other in made:
            drop_folder(spark, other)


@atexit.register
def _drop_all() -> None:
    for folder, spark in list(_folders.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_folder(spark, folder)
        except Exception:  # noqa: BLE001 - the session is gone, and its files with the cluster's scratch space
            return


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function whose worker gives its memory back when the task ends: workers are used again."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Drop the word caches that a task didn't use, free what Arrow and the C library keep."""
    tokens = sys.modules.get("loquela.llm.tokens")
    if tokens:
        tokens.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that no slice has much over `most` bytes in its text column.

    A slice has one row at least; memory follows the longest text, not the batch size.
    """
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most:
            yield batch
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)
