"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session, whose executors are this machine, may
    go without: it gets a temporary folder. Elsewhere a missing setting is an error."""
    told, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not told:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="bibmill-")
        told = _local[context.applicationId]
    return told.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it survives lost executors, ends the
    lineage, and a join of it starts from a plain shuffle, which Spark can split where
    a key is hot; beside an aggregate it can't."""
    path = f"{shared_dir(df.sparkSession)}/bibmill-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
