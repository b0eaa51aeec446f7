"""Embedding near-dedup by Euclidean p-stable hashing.

A normalised vector's hash is the cell of a Gaussian projection, shifted at
random and quantised; KEYS of them make a bucket in each of TABLES tables, and
vectors that share a bucket are compared by exact cosine in double precision.
For a cosine of 0.9 (distance 0.447) one hash agrees with probability 0.82, a
table with 0.14 and any of 24 with 0.97; at 0.95 with more than 0.999.

Equal vectors are compared once. A bucket of any size is dealt out as pairs of
blocks, so no task holds it whole; a block pair gives counts of links and a
spanning forest, not pairs. A pair counts in the first table that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, ROW, Scratch, named, partitions, runs, with_row_id
from .components import components

TABLES, KEYS, CELL, SEED, BLOCK = 24, 10, 2.0, 20, 1024
SIGNED = "cls long, copies long, dim int, vector binary, buckets array<long>"


def hash_vectors(vectors: np.ndarray, tables: int, keys: int, cell: float, seed: int) -> np.ndarray:
    """Each row's bucket in each table, for rows of length 1. The sums go in a
    fixed order, so that a vector's buckets don't hang on the rows beside it."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    lines, shift = rng.standard_normal((vectors.shape[1], tables * keys)), rng.uniform(0, cell, tables * keys)
    cells = np.floor((np.einsum("nd,dk->nk", vectors, lines, optimize=False) + shift) / cell).astype(np.int64)
    out = np.zeros((len(vectors), tables), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(keys):
            out = (out ^ cells[:, k::keys].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked with over any path."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, tables: int = TABLES, keys: int = KEYS, cell: float = CELL, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link. Equal vectors link. A null vec_id
    links like any other and is never a component_id if the component has another.
    An empty table gives no rows; other columns of df are left out."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    numbered = with_row_id(df.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).alias("v")), scratch)
    rows = numbered.select(RID, F.col(ROW)["vec_id"].alias("vec_id"), F.col(ROW)["v"].cast("array<double>").alias("v"))
    bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("v", lambda x: x == 0)
    rows = rows.withColumn("h", F.when(F.coalesce(bad, F.lit(True)), None).otherwise(F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x + 0.0).alias("v"))), 256)))
    classes = scratch.cut(rows.where("h is not null").groupBy("h").agg(F.min(RID).alias("cls"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(x) for x in b.column(2)])
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                part = b.take(pa.array(at))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
                x = x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
                buckets = hash_vectors(x, tables, keys, cell, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(at), d), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(buckets), pa.list_(pa.int64()))], ["cls", "copies", "dim", "vector", "buckets"])

    signed = scratch.cut(classes.select("cls", "copies", "v").mapInArrow(sign, SIGNED), "signed")
    places = signed.select("cls", "dim", F.posexplode("buckets").alias("t", "bucket"))
    # written before the join, which could not split a hot bucket beside an aggregate
    sizes = scratch.cut(places.groupBy("t", "bucket", "dim").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    met = places.join(sizes, ["t", "bucket", "dim"]).withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("cls", "t", "bucket", "dim", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    where = ["t", "bucket", "dim", "i", "j"]
    dealt = met.join(signed.drop("dim"), "cls").repartition(partitions(spark), *where).sortWithinPartitions(*where)

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        t, i, j = (b.column(c)[0].as_py() for c in ("t", "i", "j"))
        name, copies, blk = (b.column(c).to_numpy() for c in ("cls", "copies", "blk"))
        x = np.array([np.frombuffer(v) for v in b.column("vector").to_pylist()])
        buckets = b.column("buckets").flatten().to_numpy().reshape(len(name), -1)
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        p, q = np.nonzero(x[left] @ x[right].T >= cosine)
        p, q = left[p], right[q]
        once = p < q if i == j else np.ones(len(p), bool)
        p, q = p[once], q[once]
        first = ~(buckets[p, :t] == buckets[q, :t]).any(axis=1)
        p, q = p[first], q[first]
        if not len(p):
            return None
        n_links = np.bincount(p, copies[q], len(name)) + np.bincount(q, copies[p], len(name))
        order = np.argsort(name)
        rank = np.argsort(order)
        root = name[order][forest(len(name), rank[p], rank[q])[rank]]
        on = np.flatnonzero(n_links)
        return pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(n_links[on].astype(np.int64)), pa.array(root[on])], ["cls", "links", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, where):
            if sum(b.num_rows for b in held) > 1 and (out := links(held)) is not None:
                yield out

    found = scratch.cut(dealt.mapInArrow(compare, "cls long, links long, root long"), "found")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "cls")
    told = classes.select("h", "cls", "copies").join(counts, "cls", "left").join(roots, "cls", "left")
    told = told.select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
    all_rows = rows.select("vec_id", RID, "h").join(told, "h", "left").withColumn("root", F.coalesce("root", F.col(RID)))
    all_rows = scratch.cut(all_rows.select("vec_id", "n_links", "root"), "rows")
    least = scratch.cut(all_rows.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    return all_rows.join(least, "root").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
