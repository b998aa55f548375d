"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import string
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


#: What a Python worker holds between batches: one operator's tables at a time.
_HELD: dict[Any, Any] = {}


def let_go() -> None:
    """Free the tables that a worker holds; called where a task that needs none of them begins."""
    if _HELD:
        import pyarrow as pa

        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # where the C library has it: freed memory goes back to the system
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """A worker's tables under ``key``. Those of another operator or model are let go first."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def give_back(spark: SparkSession) -> None:
    """Executors collect garbage and return what heap they don't need, a task on each core.

    A JVM keeps the heap that a stage made it take; the Python workers of the
    next stage share the executor's memory with it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


#: What goes to a Python worker at once: texts of some thousand characters make some megabytes, on both sides of the pipe.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; sets the session's batches to bounded ones."""
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    A folder of its own is made only where that setting is absent and the
    session runs in one process, as in tests; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="arborist-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Frees a query's shuffle files when it ends; what :func:`written` wrote needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned and nothing reads any more."""
    for table_ in tables:
        spark = table_.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table_._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; the quick built-in serves pure ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )
