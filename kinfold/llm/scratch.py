"""Shared storage for intermediate tables and files, and small session helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches handed to Python hold at most this many bytes, so that very long texts cannot fill a worker.
ARROW_BATCH_BYTES = 2 << 20
ARROW_BATCH_ROWS = 4000


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only in a single local JVM (tests) a local one stands in
    where that is unset; on a cluster each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, os.path.dirname(files[0]))


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted, and give the driver's free memory back.  Spark drops the files when
    the driver's garbage is collected, which a driver with little to do puts off (half an hour at most), so a job of many
    rounds would keep them all on disk."""
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    trim_python()


def trim_jvm(spark: SparkSession) -> bool:
    """Have the driver's JVM return what it has freed outside its heap.  Compiling the code of many plans takes and frees
    much there, and the C library keeps it for each thread.  False where the JVM has no such command (HotSpot on Linux
    has it from 17.0.9 on)."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    given = new_array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    named = new_array(jvm.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        named[i] = jvm.Class.forName(kind)
    # by the interface, as the server's own class is not open to callers
    invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", named)
    try:
        invoke.invoke(server, given)
    except Py4JJavaError:
        return False
    return True


def trim_python() -> None:
    """Return what this process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives its free memory back.  Workers wait for the next stage that
    needs Python; until then what they keep is missing from the executor's other work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim_python()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a file or folder in the shared store; usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def normal_uri(uri: str) -> str:
    """``file:/x`` (Hadoop's spelling) as ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    return uri if "://" in uri else "file://" + uri
