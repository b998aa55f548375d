"""Session settings and shared-folder tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for local work; on a cluster the caller brings its own."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    builder = SparkSession.builder.master(master).appName("arborist")
    for k, v in (conf | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    One is made only where that setting is absent and the session runs in one
    process; on a cluster its absence is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="arborist-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; lost executors can't lose it."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
