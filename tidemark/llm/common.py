"""Helpers shared by the corpus operators: reading, shared-folder tables, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these six ASCII white-space characters.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Tables in a local folder get no checksum files (other stores ignore this), and none gets a mark of success. Where Hadoop
#: has no native library it starts a process to set the mode of each file, and until that process has memory of its own it
#: shares the JVM's, which is then counted twice.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_made: dict[str, list[str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset a local
    temporary folder is used in local mode only, as in tests; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _made.setdefault("local", [f"file://{tempfile.mkdtemp(prefix='tidemark-')}"])[0]
    return found.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is then its owner's to clear
        pass


def trim() -> None:
    """Give memory that this Python process has freed back to the system; a worker stays for the rest of the session."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another allocator
        pass


def hand_back(spark: SparkSession) -> None:
    """Give memory that the driver has freed back to the system, in Python and the JVM.

    Planning and exchanges take hundreds of threads, whose allocator keeps what each of
    them frees; a few milliseconds return it. Where there is no such call none is made.
    """
    trim()
    try:
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # a JVM without this command
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``: a lost executor costs only the
    tasks of the current step. Parquet is used as it is several times smaller
    than checkpoint files. Shuffle files of the finished step are released at
    once, and the table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.options(compression="zstd", **PLAIN).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    atexit.register(_forget, spark, path)
    hand_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of :func:`materialize` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _forget(df.sparkSession, path)


def words_of(text: str = "text"):
    """Column: array of the words of a text, without empty strings; null gives none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_SPLIT), lambda w: w != "")


def flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column without nulls, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(dtype, copy=False), offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
