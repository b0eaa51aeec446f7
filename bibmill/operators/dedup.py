"""Duplicate records: exact keys, MinHash over titles, components, primaries.

Bit patterns follow fixed 32-bit recipes, so signatures are computed with NumPy
in Arrow batches; everything that meets across rows is a shuffle on keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut

#: Permutations, bands, rows a band, characters a shingle, threshold.
PERMUTATIONS, BANDS, ROWS, SHINGLE, THRESHOLD = 128, 16, 8, 3, 0.85
BLOCK = 512
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def shingle_hashes(text: str) -> np.ndarray:
    """FNV-1a over each run of SHINGLE characters, distinct."""
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return codes
    if len(codes) < SHINGLE:
        codes = np.pad(codes, (0, SHINGLE - len(codes)), constant_values=32)
    h = np.full(len(codes) - SHINGLE + 1, FNV_OFFSET, np.uint32)
    for k in range(SHINGLE):
        h = (h ^ codes[k: len(h) + k]) * np.uint32(FNV_PRIME)
    return np.unique(h)


def seeds() -> np.ndarray:
    s = (np.arange(1, PERMUTATIONS + 1, dtype=np.uint32) * np.uint32(0x9E3779B9))
    s = (s ^ s >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    return s ^ s >> np.uint32(13)


def signature(text: str) -> np.ndarray | None:
    h = shingle_hashes(text)
    if not len(h):
        return None
    x = h[None, :] ^ seeds()[:, None]
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (x ^ x >> np.uint32(16)).min(axis=1).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def signatures(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else signature(t))


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda p, q: p == q), lambda x: x)) / PERMUTATIONS


def blocks_of(threshold: float):
    """Links between rows of a block and those of another, or of its own, whose roots differ."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["blk"] == i], pdf[pdf["blk"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        x, y = np.stack(left["sig"].to_list()), np.stack(right["sig"].to_list())
        same = np.zeros((len(x), len(y)), np.int32)
        for k in range(PERMUTATIONS):
            same += x[:, k][:, None] == y[:, k][None]
        p, q = np.nonzero((same / PERMUTATIONS >= threshold) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None]))
        return pd.DataFrame({"a": left["id"].to_numpy()[p], "b": right["id"].to_numpy()[q], "similarity": same[p, q] / PERMUTATIONS})

    return links


def record_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): links whose components are those of all pairs that share a band and
    agree in at least the threshold of their signatures. Equal texts are one node; each
    of its copies links with its least id. Of each band value the members are compared
    with its least id; values whose members are still apart then go through blocks of
    BLOCK, so a group costs its size, and the square over BLOCK only of what doesn't link."""
    text = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"[^a-z0-9\s]", ""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t")).where("t <> ''")
    first = cut(rows.groupBy("t").agg(F.min("id").alias("head")), "first")
    copies = rows.join(first, "t").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    signed = cut(first.select(F.col("head").alias("id"), signatures("t").alias("sig")), "signed")
    banded = signed.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)))).alias("band", "value"))
    by = ["band", "value"]
    leaders = cut(banded.groupBy(*by).agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"), "leaders")
    met = cut(banded.join(leaders, by), "met")
    x, y = signed.select(F.col("id").alias("b"), F.col("sig").alias("sb")), signed.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    led = met.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    near = cut(led.join(x, "b").join(y, "a").select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold), "near")
    roots = components(near).select(F.col("node").alias("id"), "root")
    tied = cut(met.join(roots, "id", "left").select("id", *by, "n", F.coalesce("root", "id").alias("root")), "tied")
    apart = cut(tied.groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*by), "apart")
    left = tied.join(apart, by, "left_semi").withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    dealt = left.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("id", *by, "root", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    more = dealt.join(signed, "id").groupBy(*by, "i", "j").applyInPandas(blocks_of(threshold), "a long, b long, similarity double")
    kind = near.schema["a"].dataType
    more = more.select(F.least("a", "b").cast(kind).alias("a"), F.greatest("a", "b").cast(kind).alias("b"), "similarity").distinct()
    return near.unionByName(more).unionByName(copies)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links reach. Labels spread along links and pointers
    are halved, one written table a round, until a round changes nothing."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").where("u <> v").distinct(), "edges")
    labels = cut(edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("root")), "labels")
    while True:
        near = cut(edges.join(labels.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m")), "near")
        new = labels.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("u").alias("root"), F.col("root").alias("up"))
        labels = cut(new.join(up, "root", "left").select("u", "old", F.least(F.col("root"), F.coalesce("up", "root")).alias("root")), "labels")
        if labels.where("root <> old").isEmpty():
            return labels.select(F.col("u").alias("node"), "root")
        labels = labels.select("u", "root")


def duplicate_groups(df: DataFrame, id_col: str, key, reason: str) -> DataFrame:
    """Groups of equal keys: key, primary_id (the least id), n_members, reason."""
    rows = df.select(F.col(id_col).alias("id"), key.alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.min("id").alias("primary_id"), F.count("*").alias("n_members")).where("n_members > 1").withColumn("reason", F.lit(reason))
