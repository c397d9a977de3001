"""What several operators share: table access, checkpoints and block exchange."""

from __future__ import annotations

import ctypes
import gc
import inspect
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that one Arrow batch holds at most, so that batches of long texts stay small.
TEXT_BATCH = 256
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to TEXT_BATCH, for plans with whole texts that run later.

    It is only lowered, never raised, so that the plans of several operators go together.
    """
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_BATCH:
        spark.conf.set(BATCH_ROWS, str(TEXT_BATCH))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = TEXT_BATCH):
    """Rows of an Arrow batch for the plans that run inside; the session's own number comes back."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for written tables (spark.checkpoint.dir).

    A local session without one gets a temporary folder; on a cluster that would be no
    shared place, so it is an error there.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tagmill-checkpoint-"))
    return context.getCheckpointDir()


def settle_table(df: DataFrame) -> DataFrame:
    """Like ``settle``, as a compressed Parquet table in the shared folder: for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.settled_path = path
    return out


def discard(spark: SparkSession, *paths: str | DataFrame) -> None:
    """Delete folders, or tables made by ``settle_table``, that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path if isinstance(path, str) else path.settled_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Collect garbage, so that Spark removes the shuffle files of steps that are settled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """Collect garbage in the executors, whose heaps and buffers else stay as large as earlier steps made them."""
    slots = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


@contextmanager
def one_thread():
    """Matrix products in one thread: tasks fill the cores, and threads of OpenBLAS spin while they wait.

    With another library of products than the OpenBLAS of numpy's wheels nothing changes.
    """
    import numpy

    found = [ctypes.CDLL(str(p)) for p in Path(numpy.__file__).parent.parent.glob("numpy.libs/*openblas*")]
    found = [lib for lib in found if hasattr(lib, "scipy_openblas_set_num_threads64_")]
    before = [lib.scipy_openblas_get_num_threads64_() for lib in found]
    try:
        for lib in found:
            lib.scipy_openblas_set_num_threads64_(1)
        yield
    finally:
        for lib, n in zip(found, before, strict=True):
            lib.scipy_openblas_set_num_threads64_(n)


#: Name of the module in which a worker keeps what its next tasks may use.
KEPT = "_tagmill_kept"


def kept(name: str, make: Callable):
    """What this Python worker keeps under ``name`` from task to task, made on first use."""
    home = vars(sys.modules.setdefault(KEPT, types.ModuleType(KEPT)))
    if name not in home:
        home[name] = make()
    return home[name]


def lean(run: Callable, keep: str = "") -> Callable:
    """A worker's function around which memory that nothing needs goes back to the system.

    What the worker keeps for tasks of another kind than ``keep`` is dropped first.
    """

    def tidy():
        import pyarrow

        home = vars(sys.modules.get(KEPT, types.ModuleType(KEPT)))
        for name in [n for n in home if not n.startswith("__") and n != keep]:
            del home[name]
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    def to_the_end(out):
        yield from out
        tidy()

    def start(data):
        tidy()
        out = run(data)
        return to_the_end(out) if inspect.isgenerator(out) else out

    return start
