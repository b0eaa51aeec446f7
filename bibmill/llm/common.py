"""Helpers that the operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RID, ROW = "_rid", "_row"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a
    local session, whose executors are this machine, may go without: it gets a
    temporary folder. Elsewhere a missing setting is an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="bibmill-")
        told = _local[app]
    return told.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder. Writing one cuts the lineage,
    survives lost executors, and lets Spark drop the shuffle files before it.
    Tables that a returned DataFrame reads stay; the others go with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/bibmill-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.top}/{self.n}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._bibmill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing unwritten depends on, and lets go of old shuffles."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._bibmill_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.release()

    def release(self) -> None:
        """Shuffle files go when the driver's JVM has collected their plans."""
        gc.collect()
        self.spark._jvm.System.gc()


def named(c: str) -> Column:
    return F.col(f"`{c}`")


def with_row_id(df: DataFrame, scratch: Scratch) -> DataFrame:
    """_rid and _row, written once: a row number, and df's columns as one struct, so
    that no name of theirs meets one of an operator's own. Every later plan reads the
    numbers from the table; numbers made anew by each scan hang on how Spark packs the
    file splits, and so on the cores registered when the plan is made. doc_id is not
    trusted as a key: it may be null or occur twice."""
    return scratch.cut(df.select(F.monotonically_increasing_id().alias(RID), F.struct(*map(named, df.columns)).alias(ROW)), "numbered")


def back(columns: list[str], *without: str) -> list[Column]:
    """The columns of _row, but for those that an operator's results replace."""
    gone = {c.lower() for c in without}
    return [F.col(ROW)[c].alias(c) for c in columns if c.lower() not in gone]


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(ROW)[text_col], F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of rows whose column number text holds at most so many bytes;
    a row that holds more comes alone."""
    for b in batches:
        size = np.nan_to_num(pa.compute.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each run of equal keys, from batches in order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for at, to in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
            now = tuple(c[at] for c in cols)
            if held and now != last:
                yield held
                held = []
            held.append(b.slice(at, to - at))
            last = now
    if held:
        yield held


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
